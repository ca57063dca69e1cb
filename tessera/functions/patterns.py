"""Patterns and fixed word lists, in one notation for three regex engines.

In a pattern, `\\b` is a boundary between ASCII word characters and others, `~s` the blanks of the source notation (all Unicode ones) inside a class
or alone, and `~S` anything but them; `~<` and `~>` are boundaries whose inner side is a word character, which engines test faster. java(), re2() and python() translate; case-insensitive patterns carry (?i) in front.
"""

from __future__ import annotations

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_JAVA_BLANKS = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_PYTHON_BLANKS = "\\x09-\\x0D\\x20\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


#: The same as a class of its own that asks a letter of ASCII two questions, not twelve.
_JAVA_BLANK = r"[\x09-\x0D\x20[[^\x00-\x7F]&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"


def _blanks(p: str, inner: str, alone: str | None = None) -> str:
    out, inside, k = [], False, 0
    while k < len(p):
        if p.startswith("~S", k):
            out.append(f"[^{inner}]")
            k += 2
        elif p.startswith("~s", k):
            out.append(inner if inside else alone or f"[{inner}]")
            k += 2
        elif p[k] == "\\" and k + 1 < len(p):
            out.append(p[k : k + 2])
            k += 2
        else:
            inside = p[k] == "[" if not inside else p[k] != "]"
            out.append(p[k])
            k += 1
    return "".join(out)


def _edges(p: str) -> str:
    return p.replace("~<", "(?<![A-Za-z0-9_])").replace("~>", "(?![A-Za-z0-9_])").replace(r"\b", _EDGE)


def java(p: str) -> str:
    return _edges(_blanks(p, _JAVA_BLANKS, _JAVA_BLANK)).replace("(?i)", "(?iu)")


def re2(p: str) -> str:
    return _blanks(p, _JAVA_BLANKS).replace("~<", r"\b").replace("~>", r"\b")


def python(p: str) -> str:
    return _edges(_blanks(p, _PYTHON_BLANKS))


# How published indicators are disarmed, in the order in which the rules apply (pattern, replacement with $1).
REFANG = [
    (r"(?i)\bh[\-_xX*]{1,2}t?t?p(s?)~s*(?::|\[:\]|\(:\)|\[:\/\/\]|\(:\/\/\))~s*(?:\/\/|\[\/\/\]|\[\/\]\[\/\]|)", "http$1://"),
    (r"(?i)\bht[\-_xX*]p(s?)~s*(?::\/\/|\[:\/\/\])", "http$1://"),
    (r"(?i)\b(https?)~s*\[~s*:~s*\/~s*\/~s*\]~s*", "$1://"),
    (r"(?i)\b(https?)~s*[\[\(]~s*:~s*[\]\)]~s*\/\/", "$1://"),
    (r"(?i)\bmeow(s?):\/\/", "http$1://"),
    (r"(?i)\bfxp:\/\/", "ftp://"),
    (r"~s{0,4}[\[\(\{<]~s*\.~s*[\]\)\}>]~s*", "."),
    (r"(?i)~s{0,4}[\[\(\{<]~s*(?:dot|точка)~s*[\]\)\}>]~s*", "."),
    (r"[。．｡۔․]", "."),
    (r"\\\.", "."),
    (r"~s{0,4}[\[\(\{<]~s*(?:@|at|AT|собака)~s*[\]\)\}>]~s*", "@"),
    (r"＠", "@"),
    (r"~s{0,4}[\[\(\{<]~s*:~s*[\]\)\}>]~s*", ":"),
    (r"~s{0,4}[\[\(\{<]~s*\/\/~s*[\]\)\}>]~s*", "//"),
    (r"~s{0,4}[\[\(\{<]~s*\/~s*[\]\)\}>]~s*", "/"),
]
#: What stands before the name in its run of signs, the name, the host. A run is tried once, from its start.
LOOSE_MAIL = r"(?<![A-Za-z0-9._%+-])([.%+-]*+)([A-Za-z0-9_][A-Za-z0-9._%+-]*+)~s++(?:at|AT|собака)~s++([A-Za-z0-9-]++(?:~s++(?:dot|DOT|точка)~s++[A-Za-z0-9-]++)+)"
LOOSE_MAIL_DOT = r"~s+(?:dot|DOT|точка)~s+"
_FLAT = r"[\x09\x0B\x0C\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LOOSE_DOT = _FLAT + r"{1,4}(?:dot|DOT|точка)" + _FLAT + r"{1,4}"
LOOSE_SPACED_DOT = r"(?<=[A-Za-z0-9])" + _FLAT + r"+\." + _FLAT + r"+(?=[A-Za-z0-9])"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# The indicator types in order of priority, which is also the order of output.
TYPES = {
    "tgchan": r"(?i)\b(?:https?:\/\/)?t\.me\/(?!s\/)(?:joinchat\/|\+)?[A-Za-z0-9_+-]{4,64}\b",
    "dsinvite": r"(?i)\b(?:https?:\/\/)?(?:discord\.gg|discord(?:app)?\.com\/invite)\/[A-Za-z0-9-]{2,32}\b",
    "url": r"(?i)\b(?:https?|ftp):\/\/[^~s\x00<>\x22\x27\x60\[\]{}|\\^]+",
    "email": r"\b[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b",
    "regkey": r"(?i)\bHK(?:EY_)?(?:LM|CU|CR|U|CC|LOCAL_MACHINE|CURRENT_USER|CLASSES_ROOT|USERS|CURRENT_CONFIG)\\[^~s\x00\x22\x27<>|]+",
    "winpath": r"\b[A-Za-z]:\\(?:[^\\/:*?\x22<>|\r\n\x00]+\\)*[^\\/:*?\x22<>|\r\n~s\x00]+",
    "cidr": rf"~<(?:{_OCTET}\.){{3}}{_OCTET}\/(?:3[0-2]|[12]?[0-9])~>",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?\b",
    "ipv4": rf"~<(?:{_OCTET}\.){{3}}{_OCTET}~>",
    "sha512": r"~<[A-Fa-f0-9]{128}~>",
    "sha256": r"~<[A-Fa-f0-9]{64}~>",
    "sha1": r"~<[A-Fa-f0-9]{40}~>",
    "md5": r"~<[A-Fa-f0-9]{32}~>",
    "cve": r"(?i)~<CVE-[0-9]{4}-[0-9]{4,7}~>",
    "bdu": r"(?i)(?:\bBDU|БДУ)~s*:~s*[0-9]{4}-[0-9]{5}\b",
    "attack": r"\bT[0-9]{4}(?:[./][0-9]{3}\/?)?\b",
    "asn": r"~<AS[0-9]{1,10}~>",
    "eth": r"~<0x[a-fA-F0-9]{40}~>",
    "btc": r"~<(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[ac-hj-np-z02-9]{11,71})~>",
    "onion": r"(?i)~<(?:[a-z2-7]{56}|[a-z2-7]{16})\.onion~>",
    "domain": r"\b_?(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+(?:xn--[A-Za-z0-9\-]{2,59}|[A-Za-z]{2,24})\b",
}
ORDER = list(TYPES)
#: A text in which none of these (compared in lower case) occurs holds no indicator of the type, so its pattern need not run.
SIGNS = {
    "tgchan": ["t.me/"], "dsinvite": ["discord"], "url": ["://"], "email": ["@"], "regkey": ["hk"], "winpath": [":\\"], "cidr": ["/"], "ipv6": ["::", ":"],
    "ipv4": ["."], "cve": ["cve-"], "bdu": ["bdu", "бду"], "attack": ["att", "mitre", "techniq", "техник", "tactic", "тактик", "ttp"], "asn": ["as"], "eth": ["0x"], "onion": [".onion"], "domain": ["."],
}
TECHNIQUE_CONTEXT = r"(?i)att&?ck|mitre|techniq|техник|tactic|тактик|TTP"

# Endings of file names that are no domains, and those of them that are domains all the same.
FILE_ENDINGS = """
exe dll sys scr com bat cmd ps1 psm1 vbs vbe js jse wsf hta lnk msi msp cpl ocx drv
jar class py pyc rb pl php asp aspx jsp cgi sh bash zsh
doc docx docm xls xlsx xlsm xlsb ppt pptx pptm pdf rtf odt ods odp
zip rar 7z tar gz bz2 xz cab iso img vhd vmdk
txt log csv tsv json xml yaml yml ini cfg conf toml md
png jpg jpeg gif bmp svg ico webp mp3 mp4 avi mkv mov wav
html htm css scss less ts tsx jsx vue map lock sql db sqlite bak tmp dat bin
""".split()
DOMAIN_ENDINGS = ["com", "pl"]

#: Top-level zones where the machine holds no list of them (zones.py): two Latin letters, punycode, non-Latin letters, and these generic ones.
GENERIC_ZONES = """
aero app arpa art asia biz blog cat cloud club com coop dev edu email events fun gov group guru host info int io jobs link live ltd
media mil mobi museum name net network news ninja one online org page post press pro pub pw run sale services shop site
solutions space store stream studio support systems tech tel today tools top travel vip website wiki win work works world xxx xyz zip zone
academy agency bank bar best bid buzz cafe care cash center chat click company computer cool date digital directory domains download
education energy engineering exchange expert express finance fit fund games global green health help holdings hosting house icu ink
institute international land law legal life loan market marketing mov party photo photos pictures pink plus rent report review rocks
school science security sh social software team technology trade training tv university video watch web wtf
""".split()
ZONE_RULE = r"^(?:[a-z]{2}|xn--[a-z0-9-]{2,59})$"

# Hosts whose links are a page's furniture.
PLATFORMS = [
    "x.com", "twitter.com", "t.me", "telegram.me", "telegram.org", "vk.com", "ok.ru", "dzen.ru", "max.ru", "rutube.ru", "linkedin.com", "facebook.com",
    "instagram.com", "threads.net", "youtube.com", "youtu.be", "whatsapp.com", "viber.com", "medium.com", "habr.com", "substack.com", "mastodon.social", "infosec.exchange", "bsky.app",
]
# Hosts that gather reports on indicators.
AGGREGATORS = [
    "virustotal.com", "any.run", "tria.ge", "hybrid-analysis.com", "urlscan.io", "abuse.ch", "malpedia.caad.fkie.fraunhofer.de", "attack.mitre.org", "nvd.nist.gov", "cve.org", "cve.mitre.org",
]
# Hosts of page measurement, advertising, consent and chat.
TELEMETRY = """
roistat.com google-analytics.com googletagmanager.com analytics.google.com mc.yandex.ru mc.yandex.com metrika.yandex.ru metrica.yandex.com
top-fwz1.mail.ru top.mail.ru tns-counter.ru counter.yadro.ru liveinternet.ru matomo.cloud piwik.pro plausible.io simpleanalytics.com
usefathom.com statcounter.com getclicky.com woopra.com mixpanel.com amplitude.com segment.com segment.io heap.io heapanalytics.com
posthog.com kissmetrics.io quantserve.com quantcount.com scorecardresearch.com chartbeat.com chartbeat.net parsely.com clarity.ms
hotjar.com hotjar.io fullstory.com logrocket.com logrocket.io smartlook.com smartlook.cloud crazyegg.com mouseflow.com
yandex-metrica.com nr-data.net newrelic.com cloudflareinsights.com browser-intake-datadoghq.com browser-intake-datadoghq.eu sentry.io
bugsnag.com vercel-insights.com vercel-scripts.com optimizely.com visualwebsiteoptimizer.com abtasty.com adobedtm.com demdex.net
omtrdc.net 2o7.net everesttech.net doubleclick.net googlesyndication.com googleadservices.com adservice.google.com bat.bing.com
connect.facebook.net analytics.tiktok.com ads-twitter.com analytics.twitter.com px.ads.linkedin.com criteo.com criteo.net adnxs.com
rubiconproject.com pubmatic.com openx.net taboola.com outbrain.com an.yandex.ru awaps.yandex.ru adfox.ru ads.adfox.ru ad.mail.ru
ads.mail.ru smi2.ru smi2.net adriver.ru rutarget.ru sape.ru smartcaptcha.cloud.yandex.ru captcha-api.yandex.ru recaptcha.net
hcaptcha.com challenges.cloudflare.com funcaptcha.com arkoselabs.com cookiebot.com cookielaw.org onetrust.com usercentrics.eu
iubenda.com termly.io jivosite.com jivo.chat carrotquest.io intercom.io intercomcdn.com livechatinc.com tawk.to zdassets.com
calltouch.ru uiscom.ru comagic.ru callibri.ru bitrix24.ru bitrix24.com verbox.ru envybox.io
""".split()
# Headings of reference sections and phrases beside contact addresses.
REFERENCE_HEADINGS = [
    "ссылки и дополнительные материалы", "дополнительные материалы", "ссылки", "источники", "использованные источники", "references", "further reading", "sources",
]
CONTACT_PHRASES = (
    "(?i)напишите нам|свяжитесь с нами|пишите на|обратная связь|по вопросам|контакты?:|для связи|contact us|reach out|get in touch|for more information|to learn more|questions\\?|feedback"
)
