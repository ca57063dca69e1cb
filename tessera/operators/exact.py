"""Indicators in text with everything that needs positions: ports and paths behind hosts, record cuts that go on, disarmed spellings, guess
passes over loosely disarmed and line-wrapped text. Python over Arrow batches; each text is independent."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import patterns as P
from ..functions.zones import is_zone

DELIMITERS = ",;\t|"
HASHES = (32, 40, 64, 128)
#: Furniture between the halves of a wrapped value: short lines that come at least so often, at most so many in a row.
FURNITURE_LENGTH, FURNITURE_TIMES, FURNITURE_SKIP = 24, 3, 2
TAIL = 320
_WORDED = {"email", "domain"}


@dataclass
class Indicator:
    type: str
    value: str
    n: int = 0
    defanged: bool = False
    flags: list[str] = field(default_factory=list)
    scope: str | None = None
    context: str = ""
    wrapped: list[str] | None = None

    @property
    def key(self) -> tuple[str, str]:
        return self.type, self.value.lower()


@lru_cache(maxsize=None)
def compiled(p: str) -> re.Pattern:
    return re.compile(P.python(p).replace("\\x{", "\\x{") if "\\x{" not in p else _points(P.python(p)))


def _points(p: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p)


def refang(text: str) -> str:
    for p, to in P.REFANG:
        text = compiled(p).sub(to.replace("$1", r"\g<1>"), text)
    return text


def refang_loose(text: str) -> str:
    dots = compiled(P.LOOSE_MAIL_DOT)
    text = compiled(P.LOOSE_MAIL).sub(lambda m: f"{m[1]}{m[2]}@{dots.sub('.', m[3])}", refang(text))
    return compiled(P.LOOSE_SPACED_DOT).sub(".", compiled(P.LOOSE_DOT).sub(".", text))


def zone(name: str, zones: frozenset[str] | None = None) -> str | None:
    labels = name.lower().split(".")
    if zones is not None:
        return next((z for z in (".".join(labels[-2:]), labels[-1]) if z in zones), None)
    return labels[-1] if is_zone(labels[-1]) else None


def file_name(name: str, marked: set[str]) -> bool:
    ending = name.lower().rsplit(".", 1)[-1]
    return ending in P.FILE_ENDINGS and ending not in P.DOMAIN_ENDINGS and name.lower() not in marked


# A chain begins with its run of token characters, so each run is tried once.
_CHAIN = r"(?i)(?<![A-Za-z0-9._-])[._-]*+([A-Za-z0-9][A-Za-z0-9._-]*+(?:~s{0,4}[\[({<]~s{0,4}(?:\.|dot|точка)~s{0,4}[\])}>]~s{0,4}[A-Za-z0-9][A-Za-z0-9._-]*+)+)"


def marked_values(text: str) -> set[str]:
    return {refang(m[1]).lower() for m in compiled(_CHAIN).finditer(text)}


_RUN, _ENDING = re.compile("[A-Za-z0-9._-]+"), re.compile(r"\.(?:xn--[A-Za-z0-9-]{2,59}|[A-Za-z]{2,24})(?![A-Za-z0-9_])")


def domains(text: str) -> Iterator[re.Match]:
    """Matches of the domain pattern; runs of name characters without a zone's ending are passed over, for the pattern would try each label of them."""
    pattern = compiled(P.TYPES["domain"])
    for run in _RUN.finditer(text):
        at = run.start()
        while _ENDING.search(text, at, run.end()) and (m := pattern.search(text, at, run.end())):
            yield m
            at = m.end()


def trimmed(value: str) -> str:
    while value:
        last = value[-1]
        if last in ".,;:!?'\"«»<>":
            value = value[:-1]
        elif last in ")]}" and value.count(last) > value.count("([{"[")]}".index(last)]):
            value = value[:-1]
        else:
            break
    return value


def ipv4_class(ip: str) -> str:
    a, b = (int(x) for x in ip.split(".")[:2])
    rules = (
        ("private", a == 10 or (a == 172 and 16 <= b <= 31) or (a == 192 and b == 168)), ("loopback", a == 127), ("link-local", a == 169 and b == 254),
        ("reserved", a == 0), ("cgnat", a == 100 and 64 <= b <= 127), ("multicast-reserved", a >= 224),
    )
    return next((name for name, yes in rules if yes), "global")


_SCRIPTS = [re.compile(p) for p in ("[A-Za-z]", "[\u0400-\u04ff]", "[\u0370-\u03ff]", "[\u0530-\u058f]")]


def idn_flags(name: str) -> list[str]:
    labels = name.split(".")
    plain = [x for x in labels if not x.lower().startswith("xn--")]
    kinds = [[bool(s.search(x)) for s in _SCRIPTS] for x in plain]
    flags = ["idn:puny"] * (len(plain) < len(labels)) + ["homograph"] * any(sum(k) > 1 for k in kinds)
    body = [any(s.search(x) for s in _SCRIPTS[1:]) for x in labels[:-1] if not x.lower().startswith("xn--")]
    if "homograph" not in flags and labels[-1].isascii() and labels[-1].isalpha() and any(body):
        flags.append("idn:mixed")
    return flags


def record_delimiter(counts: Counter, inside: str = "") -> str | None:
    return next((d for d in DELIMITERS if counts[d] - inside.count(d) >= 2), None)


_IDN = re.compile(r"(?<![^\W]|[_.@-])((?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.)+[^\W\d_]{2,24})(?![^\W_]|-)")
_PORT = re.compile(r":([0-9]{1,5})(?![0-9.])")
_PATH = re.compile(r"/[A-Za-z0-9._~\-/%?#&=+,;:@!$'*]{1,300}")
_AS_WORD = re.compile(r"[A-Za-z]{2}AS[0-9]")


class Lines:
    """For each line of a text whether it, or the last line before it that isn't blank, speaks of techniques."""

    def __init__(self, text: str):
        self.starts, self.speaks, at, above = [], [], 0, False
        for line in text.split("\n"):
            own = bool(re.search(P.TECHNIQUE_CONTEXT, line))
            self.starts.append(at)
            self.speaks.append(own or above)
            above = own if line.strip() else above
            at += len(line) + 1

    def named(self, at: int) -> bool:
        return self.speaks[bisect_right(self.starts, at) - 1]


class Scan:
    """One strict pass over a text."""

    def __init__(self, original: str, around: int, zones: frozenset[str] | None):
        self.original, self.text, self.around, self.zones = original, refang(original), around, zones
        self.chars, self.found, self.changed = list(self.text), {}, self.text != original
        self.marked = marked_values(original)
        for m in _IDN.finditer(self.text):
            if not m.group().isascii() and zone(m.group(), zones):
                self.claim("domain", m.group(), m.start(), len(m.group()), always=True)
        low = self.text.lower()
        for kind in P.ORDER:
            if any(s in low for s in P.SIGNS.get(kind, [""])):
                self.pass_of(kind)

    def pass_of(self, kind: str) -> None:
        snapshot, at, pattern, counts = "".join(self.chars), 0, compiled(P.TYPES[kind]), {}
        lines = Lines(snapshot) if kind == "attack" else None
        if kind == "domain":
            for m in domains(snapshot):
                if not file_name(m.group(), self.marked) and zone(m.group(), self.zones):
                    self.claim(kind, m.group(), m.start(), len(m.group()))
            return
        while m := pattern.search(snapshot, at):
            at, start, value, length = m.end(), m.start(), m.group(), len(m.group())
            if kind in ("url", "winpath", "regkey"):
                value = trimmed(value)
                left, right = snapshot.rfind("\n", 0, start) + 1, snapshot.find("\n", start)
                if left not in counts:
                    counts[left] = Counter(c for c in snapshot[left : right if right >= 0 else None] if c in DELIMITERS)
                d = record_delimiter(counts[left], value)
                if d and value.find(d) > 0:
                    length -= len(value) - value.find(d)
                    value = value[: value.find(d)]
            elif kind == "attack":
                if not lines.named(start):
                    continue
                value = re.sub(r"^T(\d{4})(?:[./](\d{3}))?.*", lambda x: f"T{x[1]}" + (f".{x[2]}" if x[2] else ""), value)
            elif kind == "bdu":
                value = "BDU:" + re.search(r"\d{4}-\d{5}", value).group()
            elif kind == "asn" and _AS_WORD.search("".join(self.chars[max(0, start - 20) : start + len(value) + 20])):
                continue
            if value:
                self.claim(kind, value, start, length)
                at = start + length

    def near(self, start: int, length: int) -> str:
        return " ".join(self.text[max(0, start - self.around) : start + length + self.around].split()) if self.around else ""

    def hide(self, start: int, length: int) -> None:
        self.chars[start : start + length] = "\x00" * length

    def claim(self, kind: str, value: str, start: int, length: int, always: bool = False) -> None:
        self.hide(start, length)
        port = None
        if kind in ("ipv4", "ipv6", "domain"):
            after = "".join(self.chars[start + length : start + length + TAIL])
            p = _PORT.match(after)
            port = p if p and 1 <= int(p[1]) <= 65535 else None
            skip = port.end() if port else 0
            self.hide(start + length, skip)
            if path := _PATH.match(after, skip):
                self.hide(start + length + skip, len(path.group()))
                self.add("url", value + (port.group() if port else "") + trimmed(path.group()), start, flags=["ambiguous:no-scheme"])
                return
        item = self.add(kind, value, start, always=always)
        if port and f"port:{port[1]}" not in item.flags:
            item.flags.append(f"port:{port[1]}")

    def add(self, kind: str, value: str, start: int, flags: list[str] | None = None, always: bool = False) -> Indicator:
        item = self.found.get((kind, value.lower()))
        if item is None:
            item = Indicator(kind, value, 0, self.changed and (always or value not in self.original), list(flags or []), context=self.near(start, len(value)))
            if kind == "ipv4":
                item.scope = ipv4_class(value)
                item.flags += [f"non-routable:{item.scope}"] * (item.scope != "global")
            elif kind == "md5":
                item.flags.append("ambiguous:md5-or-ja3")
            elif kind == "domain":
                item.flags += idn_flags(value)
            self.found[item.key] = item
        item.n += 1
        return item


def complete(value: str) -> bool:
    """Whether a line is a value by itself, so that it continues nothing."""
    v = value.strip()
    if re.fullmatch("[0-9a-fA-F]+", v) and len(v) in HASHES or re.fullmatch(r"(?i)CVE-\d{4}-\d{4,7}", v):
        return True
    if re.fullmatch(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,24}", v):
        return bool(zone(v.rsplit("@", 1)[1]))
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", v) or ("::" in v and re.fullmatch("[0-9a-fA-F:]{6,}", v)) or re.match(r"(?i)(?:https?|hxxps?|ftp)://", v):
        return True
    return bool("." in v and re.fullmatch("[A-Za-z0-9.-]+", v) and zone(v))


class Unwrap:
    """A text with values joined that a line break cut in two; joins: (joined line, its source lines)."""

    def __init__(self, text: str):
        self.lines = re.split(r"\r?\n", text)
        bare = [x.strip() for x in self.lines]
        self.hex = Counter(len(x) for x in bare if re.fullmatch("[0-9a-fA-F]{8,}", x))
        self.short = Counter(x for x in bare if x and len(x) <= FURNITURE_LENGTH)
        self.joins: list[tuple[str, list[str]]] = []
        out, k = [], 0
        while k < len(self.lines):
            line, parts = self.lines[k], [self.lines[k]]
            while True:
                j = k + 1
                while j < len(self.lines) and j - k - 1 < FURNITURE_SKIP and self.furniture(self.lines[j].strip()):
                    j += 1
                both = self.joined(line, self.bare(self.lines[j])) if j < len(self.lines) else None
                if both is None:
                    break
                line, parts, k = both, parts + self.lines[k + 1 : j + 1], j
            if len(parts) > 1:
                self.joins.append((line, parts))
            out.append(line)
            k += 1
        self.text = "\n".join(out)

    def furniture(self, line: str) -> bool:
        return bool(line) and self.short[line] >= FURNITURE_TIMES and not complete(line)

    def bare(self, line: str) -> str:
        m = re.match(r"(.*?\S)\s{2,}(\S+)\s*$", line, re.S)
        return m[1] if m and self.furniture(m[2]) else line

    def joined(self, a: str, b: str) -> str | None:
        left, right = a.rstrip(), b.lstrip()
        quote = re.compile(r"(?:[>|]\s*)+")
        if quote.match(left) and quote.match(right):
            right = quote.sub("", right, count=1)
        if not left or not right:
            return None
        delimiter = record_delimiter(Counter(left))
        if delimiter and delimiter == record_delimiter(Counter(right)):
            return None
        tail, head = re.search("[0-9a-fA-F]{8,}$", left), re.match("[0-9a-fA-F]{8,}", right)
        if tail and head:
            x, y = len(tail.group()), len(head.group())
            column = self.hex[y] >= 3 and len(right.strip()) == y
            if x + y in HASHES and not column and not (x in HASHES and y in HASHES) and re.fullmatch(r"[\s.,;)\]]*", right[y:]):
                return left + right
        if not re.search(r"(?:https?|(?i:hxxps?))://\S+$", left) or re.search(r"\s", right.strip()) or re.match(r"(?i)(?:https?|hxxps?|ftp)://", right) or complete(right):
            return None
        sentence = re.search(r"[.!?][)\]]?$", left) and not re.search(r"/\.?$", left)
        return left + right if re.match(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]{2,}", right) and not sentence else None

    def source(self, value: str) -> list[str] | None:
        for line, parts in self.joins:
            armed = refang(line)
            if value in armed or armed in value or value in line or line in value:
                return parts
        return None


def extract(text: str | None, around: int = 60, loose: bool = True, zones: frozenset[str] | None = None) -> list[Indicator]:
    """The indicators of a text: certain ones in order of type, count and value, then those of the guess passes."""
    original = text or ""
    out = sorted(Scan(original, around, zones).found.values(), key=lambda i: (P.ORDER.index(i.type), -i.n, i.value))
    if not loose:
        return out
    seen, wrap = {i.key for i in out}, Unwrap(original)
    for flag, changed, base in (("ambiguous:refang", refang_loose(original), refang(original)), ("ambiguous:wrap", wrap.text, original)):
        for i in extract(changed, around, False, zones) if changed != base else ():
            if i.key not in seen:
                seen.add(i.key)
                i.flags.append(flag)
                i.wrapped = wrap.source(i.value) if flag == "ambiguous:wrap" else None
                out.append(i)
    return without_fragments(out, wrap.joins)


_BASE58, _BECH32 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def wallet(value: str) -> bool:
    """Whether a match of the btc pattern bears its checksum (Base58Check, Bech32 or Bech32m)."""
    if value.startswith("bc1"):
        check = 1
        for v in (3, 3, 0, 2, 3, *map(_BECH32.index, value[3:])):
            top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
            for k, step in enumerate(_BECH32_STEPS):
                check ^= step if top >> k & 1 else 0
        return check in (1, 0x2BC830A3)
    number = 0
    for c in value:
        number = number * 58 + _BASE58.index(c)
    raw = number.to_bytes(26, "big")
    return raw[0] == 0 and sha256(sha256(raw[1:22]).digest()).digest()[:4] == raw[22:]


def hash_piece(item: Indicator, whole: Indicator, joins: list[tuple[str, list[str]]]) -> bool:
    """Whether a btc match is no address by its checksum and stands nowhere but as a piece of a joined hash."""
    piece, joined = item.value.lower(), whole.value.lower()
    if item.type != "btc" or len(joined) not in HASHES or not re.fullmatch("[0-9a-f]+", joined) or piece not in joined or wallet(item.value):
        return False
    ends, begins = re.compile(rf"(?i)(?<![A-Za-z0-9_]){piece}\s*$"), re.compile(rf"(?i)\s*(?:[>|]\s*)*{piece}(?![A-Za-z0-9_])")
    own = [parts for line, parts in joins if joined in line.lower()]
    return item.n <= sum(bool(ends.search(parts[0])) + sum(bool(begins.match(p)) for p in parts[1:]) for parts in own)


def without_fragments(found: list[Indicator], joins: list[tuple[str, list[str]]]) -> list[Indicator]:
    """Drops the first halves of values that a wrap had cut and pieces of joined hashes that only look like addresses, and flags other values that are a
    whole source line."""
    whole = [i for i in found if "ambiguous:wrap" in i.flags and i.wrapped]
    gone = set()
    for w in whole:
        first = refang(w.wrapped[0].rstrip()).lower()
        gone |= {id(i) for i in found if i is not w and i.type == w.type and len(i.value) < len(w.value) and w.value.lower().startswith(i.value.lower()) and first.endswith(i.value.lower())}
        gone |= {id(i) for i in found if hash_piece(i, w, joins)}
    left = [i for i in found if id(i) not in gone]
    for w in whole:
        lines = {p.strip().lower() for p in w.wrapped}
        for i in left:
            if i is not w and i.value.lower() in lines and "ambiguous:wrap-part" not in i.flags:
                i.flags.append("ambiguous:wrap-part")
    return left


SCHEMA = "doc_id long, ord int, type string, value string, n long, defanged boolean, flags array<string>, scope string, context string, wrapped array<string>"


def extracted(docs: DataFrame, around: int = 60, loose: bool = True, zones: frozenset[str] | None = None) -> DataFrame:
    """A row for each indicator of each text, in order. Null text has none; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            rows = [
                (doc, k, i.type, i.value, i.n, i.defanged, i.flags, i.scope, i.context, i.wrapped)
                for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)
                for k, i in enumerate(extract(text, around, loose, zones))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
