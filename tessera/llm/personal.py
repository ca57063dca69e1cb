"""Finds personal data: e-mail addresses, IP addresses, card numbers, phone numbers.

Method: patterns give the base spans, and a character-level BiLSTM-CRF (tagger.py) adds spans that they miss, such as phone numbers without a
plus sign. The text is tagged in overlapping windows; spans that touch a base span yield to it, and of the others the heaviest set that
does not overlap is taken over the whole text (weights: the log odds of the tags against `O`). An added span must hold what its kind needs
(an @ with a dot after it, or the right digits), so windows that hold neither an @ nor four digits outside base spans cannot add one and are not tagged.
The weights were trained once (tagger.py) and lie beside the code.

n_email and so on count the base spans; n_added counts the others.

Defined results: null text is empty and has no spans (redacted() leaves it null); a repeated row is searched again; an empty table gives an empty
table; other columns are not read. No pattern backtracks over more than its own match, so long texts take time in proportion.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tagger
from .tagger import KINDS, WINDOW, Tagger, luhn

STRIDE = 80
#: Windows that are tagged at once.
AT_ONCE = 512
#: The log of the odds by which an added span's tags must beat `O` all along, transitions counted.
MARGIN = 4.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that cannot start a match at its first digit cannot at a later one, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Each @ with the longest run of local characters before it, after the last match, and a domain behind it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", *m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield "phone", *m.span()


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    return [*(emails(text) if "@" in text else ()), *ips(text), *cards(text), *(phones(text) if "+" in text else ())]


def plausible(kind: str, part: str) -> bool:
    """Whether the part holds what a span of its kind needs."""
    digits = _NO_DIGIT.sub("", part)
    if kind == "email":
        name, at, domain = part.partition("@")
        return bool(at and name and "." in domain[1:-1] and not re.search(r"\s", part))
    if kind == "ip":
        parts = part.split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1 and not re.search("[A-Za-z]", part)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\(?[0-9]+(?:[ ().-]{1,2}[0-9]+){2,5}", part)) and len(re.findall("[0-9]+", part)[-1]) >= 3


def chosen(spans: list[tuple[float, str, int, int]]) -> list[Span]:
    """The spans of the heaviest set without overlaps; of equal sets the one found first in order of ends."""
    spans = sorted(set(spans), key=lambda s: (s[3], s[2], s[1], -s[0]))
    ends = [s[3] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    from bisect import bisect_right

    for k, (w, _, start, _) in enumerate(spans):
        take = w + best[bisect_right(ends, start, 0, k)][0]
        best.append((take, k) if take > best[-1][0] else (best[-1][0], -1))
    out, k = [], len(spans)
    while k:
        if best[k][1] < 0:
            k -= 1
        else:
            _, kind, start, end = spans[k - 1]
            out.append((kind, start, end))
            k = bisect_right(ends, start, 0, k - 1)
    return out[::-1]


class Finder:
    def __init__(self, model: Tagger):
        self.model = model

    def windows(self, codes: np.ndarray, base: list[Span]) -> np.ndarray:
        """The starts of the windows that can add a span."""
        free = np.ones(len(codes), bool)
        for _, a, b in base:
            free[a:b] = False
        digit = np.append(0, np.cumsum((codes >= 48) & (codes <= 57) & free))
        sign = np.append(0, np.cumsum((codes == 64) & free))
        starts = np.arange(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE)
        ends = np.minimum(starts + WINDOW, len(codes))
        return starts[(digit[ends] - digit[starts] >= 4) | (sign[ends] > sign[starts])]

    def batch(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """For each text its base spans and the added ones."""
        found = [base_spans(t) for t in texts]
        heavy: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
        held: list[tuple[int, int, np.ndarray]] = []
        for k, (t, base) in enumerate(zip(texts, found, strict=True)):
            if not t:
                continue
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            for at in self.windows(codes, base).tolist():
                held.append((k, at, tagger.classes(codes[at : at + WINDOW])))
                if len(held) == AT_ONCE:
                    self.tag(texts, held, heavy)
                    held = []
        if held:
            self.tag(texts, held, heavy)
        out = []
        for base, extra in zip(found, heavy, strict=True):
            out.append((base, chosen(free_of(extra, sorted((a, b) for _, a, b in base)))))
        return out

    def tag(self, texts: list[str], held: list[tuple[int, int, np.ndarray]], heavy: list[list[tuple[float, str, int, int]]]) -> None:
        x = np.zeros((len(held), WINDOW), np.int64)
        for r, (_, _, c) in enumerate(held):
            x[r, : len(c)] = c
        tags, gain = self.model.decode(x)
        for r in np.flatnonzero((tags > 0).any(1)).tolist():
            k, at, c = held[r]
            text, row, start = texts[k], tags[r], -1
            edges = np.flatnonzero(np.diff(np.concatenate([[0], np.where(row > 0, (row + 1) // 2, 0), [0]])) != 0).tolist()
            begins = set(np.flatnonzero(row % 2 == 1).tolist())
            cuts = sorted({*edges, *begins})
            for start, end in zip(cuts, [*cuts[1:], len(c)], strict=True):
                end = min(end, len(c))
                if start >= end or row[start] == 0:
                    continue
                inside = (start > 0 or at == 0) and (end < WINDOW or at + end == len(text))
                kind = KINDS[(row[start] + 1) // 2 - 1]
                a, b = at + start, at + end
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1] in " .,;:-\n":
                    b -= 1
                weight = float(gain[r, start:end].sum()) + self.model.ahead(row, start, end)
                # A number inside a longer one, or a word, is none by itself.
                alone = (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "@._-+/:#")) and (b == len(text) or not (text[b].isalnum() or text[b : b + 1] in "@_/"))
                if inside and alone and weight > MARGIN and plausible(kind, text[a:b]):
                    heavy[k].append((weight, kind, a, b))


def free_of(spans: list[tuple[float, str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[float, str, int, int]]:
    """The weighted spans that touch none of the taken runs, which are in order of start."""
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, k = [], 0
    for s in sorted(spans, key=lambda s: s[2]):
        while k < len(merged) and merged[k][1] <= s[2]:
            k += 1
        if k == len(merged) or merged[k][0] >= s[3]:
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, at, upto = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= upto:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = upto = max(upto, b)
    return "".join([*out, text[at:]])


def _model(docs: DataFrame, model: Tagger | None):
    return docs.sparkSession.sparkContext.broadcast((model or tagger.default()).p)


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, counts of the base spans, base_sha256, spans, n_added for every row."""
    known = _model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Tagger(known.value))
        for batch in batches:
            rows = []
            for base, added in finder.batch([t or "" for t in batch["text"].to_pylist()]):
                kinds = [s[0] for s in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets."""
    known = _model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Tagger(known.value))
        for batch in batches:
            texts = batch["text"].to_pylist()
            new = [t if t is None else masked(t, base + added) for t, (base, added) in zip(texts, finder.batch([t or "" for t in texts]), strict=True)]
            size = [n if t is None else len(t) for t, n in zip(new, batch["n_chars"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["doc_id"], pa.array(new, pa.string()), batch["lang"], batch["source"], pa.array(size, pa.int64())], names=list(common.DOCUMENT))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return own.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
