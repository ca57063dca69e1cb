"""Text functions as column expressions: notation, codecs, hashes, classes of addresses and domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import zones

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: C) -> Column:
    """Runs of blanks as one space. Blanks beyond ASCII are looked for by their bytes, since a class that holds them is ten times as slow to match."""
    x = col(c)
    data = x.cast("binary")
    rare = F.contains(data, F.lit(b"\xc2\xa0"))
    for sign in (b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf"):
        rare = rare | F.contains(data, F.lit(sign))
    return F.when(rare, F.regexp_replace(x, P.java("~s+"), " ")).otherwise(F.regexp_replace(x, r"[\x09-\x0D\x20]+", " "))


def refang(c: C) -> Column:
    """Undoes disarmed notation. Most texts hold none of its signs and pass through unchanged at the cost of one scan."""
    x = col(c)
    signs = r"(?iu)[\[\(\{<]|h[\-_x*]{1,2}t?t?p|ht[\-_x*]p|meows?:|fxp:|[。．｡۔․＠\\]"
    return F.when(x.rlike(signs), reduce(lambda out, r: F.regexp_replace(out, F.lit(P.java(r[0])), F.lit(r[1])), P.REFANG, x)).otherwise(x)


def refang_loose(c: C) -> Column:
    """refang(), then words for signs: `a at b dot c`, ` dot `, and a dot between blanks."""
    x = refang(c)
    mail = F.regexp_replace(x, F.lit(P.java(P.LOOSE_MAIL)), F.lit("$1$2@$3"))
    # The replaced address keeps its worded dots, which the next rule turns into signs as well.
    dots = F.regexp_replace(mail, F.lit(P.java(P.LOOSE_DOT)), F.lit("."))
    return F.regexp_replace(dots, F.lit(P.java(P.LOOSE_SPACED_DOT)), F.lit("."))


def defang(c: C) -> Column:
    x = F.regexp_replace(col(c), r"(?i)^http(s?)://", "hxxp$1://")
    x = F.regexp_replace(x, r"(?i)^ftp://", "fxp://")
    return F.replace(F.replace(x, F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))


def defanged_values(c: C) -> Column:
    """The values that the author disarmed, as they read when armed; a chain of separators is one value."""
    sep = r"[\[({<]~s{0,4}(?:\.|dot|точка)~s{0,4}[\])}>]"
    # A chain begins with its run of token characters, so each run is tried once.
    chain = rf"(?i)(?<![A-Za-z0-9._-])[._-]*+([A-Za-z0-9][A-Za-z0-9._-]*+(?:~s{{0,4}}{sep}~s{{0,4}}[A-Za-z0-9][A-Za-z0-9._-]*+)+)"
    return F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(P.java(chain)), F.lit(1)), lambda v: F.lower(refang(v))))


def trim_tail(c: C) -> Column:
    """An address without what follows it in prose: punctuation, and closing brackets that nothing opens.

    Each round drops all trailing punctuation and one bracket; eight rounds are more brackets than addresses end in.
    """
    bare = lambda x: F.regexp_replace(x, r"""[.,;:!?'"«»<>]+$""", "")

    def step(x: Column, _: Column) -> Column:
        many = lambda ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
        loose = [x.endswith(close) & (many(close) > many(open_)) for open_, close in ("()", "[]", "{}")]
        return F.when(loose[0] | loose[1] | loose[2], bare(F.regexp_replace(x, r".\z", ""))).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), bare(col(c)), step)


def canonical_technique(c: C) -> Column:
    x = F.regexp_extract(col(c), r"^T(\d{4})", 1)
    sub = F.regexp_extract(col(c), r"^T\d{4}[./](\d{3})", 1)
    return F.concat(F.lit("T"), x, F.when(sub != "", F.concat(F.lit("."), sub)).otherwise(""))


def canonical_bdu(c: C) -> Column:
    return F.concat(F.lit("BDU:"), F.regexp_extract(col(c), r"(\d{4}-\d{5})", 1))


def octet(c: C, i: int) -> Column:
    return F.try_element_at(F.split(col(c), r"\."), F.lit(i + 1)).try_cast("int")


def ipv4_class(c: C) -> Column:
    a, b = octet(c, 0), octet(c, 1)
    return (
        F.when(a == 10, "private").when((a == 172) & b.between(16, 31), "private").when((a == 192) & (b == 168), "private").when(a == 127, "loopback")
        .when((a == 169) & (b == 254), "link-local").when(a == 0, "reserved").when((a == 100) & b.between(64, 127), "cgnat").when(a >= 224, "multicast-reserved").otherwise("global")
    )


def ipv4_number(c: C) -> Column:
    """The address as a number; null where it isn't four parts of 0 to 255 without leading zeros."""
    x = col(c)
    good = x.rlike(r"\A(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})\z")
    part = [octet(x, i).cast("long") for i in range(4)]
    fits = reduce(lambda a, b: a & b, [p <= 255 for p in part])
    return F.when(good & fits, part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def ipv4_text(c: C) -> Column:
    x = col(c)
    return F.concat_ws(".", *[(F.shiftrightunsigned(x, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def zone(c: C) -> Column:
    """The last label if it is a top-level zone by the machine's list, or by rule where there is none (zones.py); else null."""
    last = F.element_at(F.split(F.lower(col(c)), r"\."), -1)
    if listed := zones.known():
        return F.when(F.array_contains(F.split(F.lit(" ".join(sorted(listed))), " "), last), last)
    known = last.rlike(P.ZONE_RULE) | last.isin(P.GENERIC_ZONES) | last.rlike(r"\A[\p{L}&&[^\x00-\x7F]][\p{L}]+\z")
    return F.when(known, last)


def file_name(c: C, marked: Column | None = None) -> Column:
    """Whether the name ends like a file's; a value that the author disarmed is no file."""
    ending = F.element_at(F.split(F.lower(col(c)), r"\."), -1)
    files = [e for e in P.FILE_ENDINGS if e not in P.DOMAIN_ENDINGS]
    is_file = ending.isin(files)
    return is_file if marked is None else is_file & ~F.array_contains(marked, F.lower(col(c)))


def idn_flags(c: C) -> Column:
    """`idn:puny`, `homograph` (two scripts in a label), `idn:mixed` (a foreign label under a Latin zone)."""
    labels = F.split(col(c), r"\.")
    puny = lambda x: x.rlike(r"(?i)^xn--")
    scripts = ["[A-Za-z]", r"[\x{0400}-\x{04FF}]", r"[\x{0370}-\x{03FF}]", r"[\x{0530}-\x{058F}]"]
    several = lambda x: sum(x.rlike(s).cast("int") for s in scripts) > 1
    foreign = lambda x: ~puny(x) & (x.rlike(scripts[1]) | x.rlike(scripts[2]) | x.rlike(scripts[3]))
    homograph = F.exists(labels, lambda x: ~puny(x) & several(x))
    body = F.slice(labels, F.lit(1), F.size(labels) - 1)
    mixed = F.element_at(labels, -1).rlike(r"\A[A-Za-z]+\z") & F.exists(body, foreign) & ~homograph
    return F.array_compact(F.array(F.when(F.exists(labels, puny), "idn:puny"), F.when(homograph, "homograph"), F.when(mixed, "idn:mixed")))


def url_host(c: C) -> Column:
    return F.lower(F.regexp_extract(col(c), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def url_scheme(c: C) -> Column:
    return F.lower(F.regexp_extract(col(c), r"(?i)^([a-z][a-z0-9+.-]*)://", 1))


def url_port(c: C) -> Column:
    return F.regexp_extract(col(c), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/:?#]*):(\d+)", 1)


def url_path(c: C) -> Column:
    path = F.regexp_extract(col(c), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(url_host(c) != "", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))).otherwise("")


def host_of(type_: C, value: C) -> Column:
    """The host of an indicator: a domain is its own, an address with a scheme has one, an e-mail's stands after the @."""
    t, v = col(type_), F.trim(col(value))
    return F.when(t == "domain", F.lower(v)).when(t == "url", url_host(v)).when(t == "email", F.lower(F.coalesce(F.try_element_at(F.split(v, "@"), F.lit(2)), F.lit("")))).otherwise("")


def under(host: C, base: C) -> Column:
    h, b = F.lower(col(host)), F.lower(col(base))
    return (h != "") & (b != "") & ((h == b) | h.endswith(F.concat(F.lit("."), b)))


def percent_encode(c: C) -> Column:
    """Percent-encoding of a URL part: form encoding, with its blanks and the marks that stay literal put right."""
    x = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(code), F.lit(mark))
    return x


def percent_decode(c: C) -> Column:
    """Up to three rounds of decoding, with + as a blank; null if malformed."""
    return F.try_url_decode(F.try_url_decode(F.try_url_decode(col(c))))


def hex_text(c: C) -> Column:
    clean = F.regexp_replace(F.regexp_replace(col(c), "(?i)0x", ""), P.java(r"[~s,:-]+"), "")
    return F.when(clean.rlike(r"\A(?:[0-9a-fA-F]{2})+\z"), F.decode(F.unhex(clean), "UTF-8"))


def text_hex(c: C) -> Column:
    return F.lower(F.hex(F.encode(col(c), "UTF-8")))


def looks_like_base64(c: C) -> Column:
    t = F.trim(col(c))
    return (F.length(t) >= 16) & (F.length(t) % 4 == 0) & t.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & ~t.rlike(r"\A[0-9a-fA-F]+\z") & t.rlike("[a-z]") & t.rlike("[A-Z0-9+/]")


def text_score(c: C) -> Column:
    x = col(c)
    n = F.greatest(F.length(x), F.lit(1))
    null = F.length(x) - F.length(F.translate(x, "\x00", ""))
    odd = F.regexp_count(x, F.lit(r"[\x{1}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFD}]"))
    return F.when(x == "", 0.0).otherwise(F.greatest(F.lit(0.0), (n - null - odd - 2 * null) / n))


def base64_text(c: C) -> Column:
    """struct(encoding, text) of base64 data: UTF-16LE if it reads clearly better than UTF-8; null if it is no base64."""
    data = F.try_to_binary(F.regexp_replace(col(c), P.java("~s+"), ""), F.lit("base64"))
    eight = F.decode(data, "UTF-8")
    sixteen = F.decode(F.substring(data, F.lit(1), (F.octet_length(data) - F.octet_length(data) % 2).cast("int")), "UTF-16LE")
    wide = text_score(sixteen) > text_score(eight) + 0.15
    return F.when(F.octet_length(data) > 0, F.struct(F.when(wide, "UTF-16LE").otherwise("UTF-8").alias("encoding"), F.when(wide, sixteen).otherwise(eight).alias("text")))


def base64_runs(c: C) -> Column:
    """The distinct base64 values of a text: arguments of -enc and its kin, then long runs that pass the test."""
    x = col(c)
    flag = F.regexp_extract_all(x, F.lit(r"(?i)-(?:e|ec|enc|encodedcommand)[\x09-\x0D\x20]+([A-Za-z0-9+/=]{16,})"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9+/]{24,}={0,2}"), F.lit(0)), looks_like_base64)
    return F.array_distinct(F.concat(flag, runs))


def detect_type(c: C) -> Column:
    """The type of a single value: the first pattern that it matches whole, else keyword; null for an empty value."""
    value = refang(F.trim(col(c)))
    out = F.when(value == "", F.lit(None).cast("string"))
    for name, p in P.TYPES.items():
        body = P.java(p)
        case = "(?iu)" if body.startswith("(?iu)") else ""
        hit = value.rlike(rf"{case}\A(?:{body.removeprefix('(?iu)')})\z")
        if name == "domain":
            hit = hit & ~file_name(value, defanged_values(c)) & zone(value).isNotNull()
        out = out.when(hit, name)
    return out.otherwise("keyword")


def tlp(c: C) -> Column:
    """`TLP:AMBER` and the like from loose spellings; anything else is null."""
    x = F.regexp_replace(F.upper(F.trim(col(c))), r"^TLP[\s:_-]*", "")
    return F.when(x.isin("CLEAR", "WHITE", "GREEN", "AMBER", "AMBER+STRICT", "RED"), F.concat(F.lit("TLP:"), x))


def base_domain(c: C) -> Column:
    """The last two labels of a domain, three under a two-label zone."""
    labels = F.split(F.lower(col(c)), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    return F.when((F.size(labels) > 2) & two.isin(TWO_LABEL_ZONES), three).otherwise(two)


# Zones of two labels in mail domains.
TWO_LABEL_ZONES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "com.au", "com.br", "com.cn", "com.ru", "net.ru", "org.ru", "com.tr"]
