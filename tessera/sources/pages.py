"""Web pages by their tree: answers of servers decoded, pages as text for extraction, the text that a page shows, pages of a capture.

`files.page_text` is the same by expressions, for tables where a regular page is enough; here the tree decides what belongs to what. A page is one
row's value; nothing is shuffled. Null pages are empty ones; lengths are in code points.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import embedded_strings

# Tags without text, tags and names of furniture, tags that end a line, attributes with addresses, and what isn't one.
DROPPED = "script style noscript template svg canvas iframe object embed".split()
CHROME = "nav header footer aside form button select dialog".split()
CHROME_NAMES = re.compile(
    r"(?:^|[-_ ])(?:nav|menu|header|footer|sidebar|social|share|subscribe|newsletter|cookie|banner|breadcrumb|pagination|related|promo|advert|widget|popup|modal|toolbar|copyright)(?:[-_ ]|$)", re.I
)
CHROME_ROLES = ("navigation", "banner", "contentinfo")
BLOCKS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul"
).split()
LINKS = ("href", "src", "data-url", "action")
NO_ADDRESS = re.compile(r"\s*(?:javascript|data|blob|vbscript|about|#)", re.I)
UNSEEN = "script style noscript template svg canvas textarea input select option".split()
FIELDS = "textarea input select".split()
REFUSED = r"^(?:image|audio|video|application/(?:zip|octet-stream|pdf))"
MOST_BYTES, META, SHOWN = 5 * 1024 * 1024, 2048, 300_000
ARTICLE, RATIO, LEFT = 900, 25, 0.4

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """A page's parts in order: texts, and elements as [tag, attributes, first part, part behind the last, parent]."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parts: list[str | int] = []
        self.elements: list[list] = []
        self.open: list[int] = []
        self.depth: dict[str, int] = {}
        self.owner: list[int] = []
        self.feed(html)
        self.close()
        while self.open:
            self._end()

    def _add(self, part: str | int) -> None:
        self.parts.append(part)
        self.owner.append(self.open[-1] if self.open else -1)

    def _end(self) -> None:
        e = self.elements[self.open.pop()]
        e[3] = len(self.parts)
        self.depth[e[0]] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.elements.append([tag, {k: v or "" for k, v in reversed(attrs)}, len(self.parts), len(self.parts) + 1, self.open[-1] if self.open else -1])
        self._add(len(self.elements) - 1)
        if tag not in _VOID:
            self.open.append(len(self.elements) - 1)
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.depth.get(tag):
            while self.elements[self.open[-1]][0] != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        self._add(data)

    def spans(self, which: Callable[[list], bool], first: int = 0, end: int | None = None) -> list[list]:
        """The outermost such elements among the parts from `first` on, in order."""
        out, upto = [], first
        end = len(self.parts) if end is None else end
        for e in self.elements:
            if upto <= e[2] < end and which(e):
                out.append(e)
                upto = e[3]
        return out

    def walk(self, first: int, end: int, without: list[list]) -> Iterator[str | int]:
        at = first
        for e in [*without, None]:
            stop = end if e is None else min(e[2], end)
            yield from self.parts[at:stop]
            if e is not None:
                at = max(at, e[3])

    def owned(self, without: list[list]) -> Iterator[tuple[str | int, int]]:
        """All parts but those, each with the element that it stands in."""
        at = 0
        for e in [*without, None]:
            stop = len(self.parts) if e is None else e[2]
            yield from zip(self.parts[at:stop], self.owner[at:stop], strict=True)
            at = stop if e is None else e[3]


def _chrome(e: list) -> bool:
    a = e[1]
    return e[0] in CHROME or bool(CHROME_NAMES.search(f"{a.get('class', '')} {a.get('id', '')}")) or a.get("role", "").lower() in CHROME_ROLES


def read_page(html: str | None) -> tuple[str, str, list[str]]:
    """(title, text, notes) of a page: its article, else its main part, else its body, without furniture, a line for each block, then the addresses that it holds.

    Furniture stays where less than two fifths of the text would be left; a page drawn by scripts gives the strings of its embedded data."""
    html = html or ""
    tree = Tree(html)
    dropped = tree.spans(lambda e: e[0] in DROPPED)
    starts = [d[2] for d in dropped]
    inside = lambda e: (k := bisect_right(starts, e[2])) > 0 and e[2] < dropped[k - 1][3]
    named = {}
    for e in tree.elements:
        if e[0] in ("article", "main", "body", "title") and e[0] not in named and not inside(e):
            named[e[0]] = e
    title = "".join(p for p in tree.walk(*named["title"][2:4], []) if isinstance(p, str)).strip() if "title" in named else ""
    root = named.get("article") or named.get("main") or named.get("body")
    if root:
        first, end, other = root[2] + 1, root[3], ()
    else:
        first, end, other = 0, len(tree.parts), ("head", "title")

    def length(without: list[list]) -> int:
        return len("".join(p for p in tree.walk(first, end, without) if isinstance(p, str)).strip())

    plain = tree.spans(lambda e: e[0] in DROPPED or e[0] in other, first, end)
    bare = tree.spans(lambda e: e[0] in DROPPED or e[0] in other or _chrome(e), first, end)
    before, notes = length(plain), []
    if before and length(bare) < LEFT * before:
        bare = plain
        notes.append("furniture kept")
    # A block ends its line behind its last part; one whose end tag lacks ends with its parent.
    ends: dict[int, int] = {}
    links, text = [], []
    for p in tree.walk(first, end, bare):
        if not isinstance(p, str):
            e = tree.elements[p]
            links += [e[1][k] for k in LINKS if e[1].get(k) and not NO_ADDRESS.match(e[1][k])]
            if e[0] in BLOCKS:
                ends[e[3]] = ends.get(e[3], 0) + 1
    skip = {e[2]: e[3] for e in bare}
    at = first
    while at < end:
        text.append("\n" * ends.pop(at, 0))
        if at in skip:
            at = skip[at]
            continue
        if isinstance(tree.parts[at], str):
            text.append(tree.parts[at])
        at += 1
    text.extend("\n" * n for n in ends.values())
    body = "".join(text)
    joined = lambda b: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n".join([title, b, *links])))
    out, size = joined(body), len(body.strip())
    if size < ARTICLE and len(html) > RATIO * size:
        data = "\n".join(embedded_strings(html))
        if len(data.strip()) > size:
            out = joined(data)
            notes.append("from embedded data")
        else:
            notes.append("a script's shell")
    return title, out, notes


def shown_text(html: str | None) -> str:
    """What a page shows, a line for each text, then the addresses of its elements.

    Without a style sheet's engine a text is hidden by its own element's `hidden` or style, and by the visibility of those around it; fields that are typed into are left out."""
    tree = Tree(html or "")
    none, unseen, typed = [], [], []
    for tag, attrs, _, _, parent in tree.elements:
        style = re.sub(r"\s", "", attrs.get("style", "")).lower()
        none.append("display:none" in style or "hidden" in attrs)
        unseen.append("visibility:hidden" in style or (parent >= 0 and unseen[parent] and "visibility:visible" not in style))
        typed.append(tag in FIELDS or attrs.get("contenteditable", "").lower() == "true" or (parent >= 0 and typed[parent]))
    inert = tree.spans(lambda e: e[0] in ("template", "noscript"))
    parts, links = [], []
    for p, owner in tree.owned(inert):
        if isinstance(p, str):
            e = tree.elements[owner] if owner >= 0 else None
            if p.strip() and not (e and (e[0] in UNSEEN or e[0] in ("head", "title") or none[owner] or unseen[owner] or typed[owner])):
                parts.append(p)
        else:
            links += [v for k in LINKS if (v := tree.elements[p][1].get(k)) and not v.startswith("javascript:")]
    return "\n".join(parts + links)


def texts(pages: DataFrame) -> DataFrame:
    """page_id, title, text, notes for each row of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_page(h.as_py()) for h in batch["html"]]
            notes = pa.array([n for _, _, n in rows], pa.list_(pa.string()))
            yield pa.record_batch([batch["page_id"], *(pa.array([_clean(r[k]) for r in rows], pa.string()) for k in (0, 1)), notes], names=["page_id", "title", "text", "notes"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, title string, text string, notes array<string>")


def shown(pages: DataFrame) -> DataFrame:
    """page_id, text that each page (page_id, html) shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["page_id"], pa.array([_clean(shown_text(h.as_py())) for h in batch["html"]], pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string")


def _clean(s: str) -> str:
    """A reference to half a surrogate pair has no place in UTF-8."""
    return s.encode("utf-8", "replace").decode()


def decoded(content: bytes, header: str | None) -> tuple[str, str]:
    """(text, charset): by the header's charset, else UTF-8; another one that the first characters name is taken instead if it is known."""
    charset = (re.search(r"charset=([\w-]+)", (header or "").lower()) or [None, "utf-8"])[1]
    try:
        text = _decode(content, charset)
    except LookupError:
        text, charset = _decode(content, "utf-8"), "utf-8"
    named = re.search(r"charset=[\"']?([\w-]+)", text[:META], re.I)
    if named and named[1].lower() != charset:
        try:
            return _decode(content, named[1]), named[1].lower()
        except LookupError:
            pass
    return text, charset


def _decode(content: bytes, charset: str) -> str:
    """Browsers read the names of Latin-1 and ASCII as Windows-1252, and drop a byte order mark."""
    name = codecs.lookup(charset).name
    if not getattr(codecs.lookup(name), "_is_text_encoding", True):
        raise LookupError(charset)
    return content.decode("cp1252" if name in ("iso8859-1", "ascii") else name, "replace").removeprefix("\ufeff")


def refusal(status: Column, content_type: Column, size: Column) -> Column:
    """Why an answer isn't read as a page, or null."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(~F.coalesce(status.between(200, 299), F.lit(False)), F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("none"))))
        .when(kind.rlike(REFUSED) & kind.contains("pdf"), "a PDF")
        .when(kind.rlike(REFUSED), F.concat(F.lit("not a page: "), F.substring_index(kind, ";", 1)))
        .when(size > MOST_BYTES, "over 5 MB")
    )


def answers(responses: DataFrame) -> DataFrame:
    """id, refused, charset, is_html, text of answers (id, status, content_type, content); of refused ones nothing is read."""
    size = F.octet_length(F.coalesce("content", F.lit(b"")))
    rows = responses.select(F.col("id").cast("long").alias("id"), "content_type", "content", refusal(F.col("status"), F.col("content_type"), size).alias("refused"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, content, refused in zip(*(batch[c].to_pylist() for c in ("content_type", "content", "refused")), strict=True):
                text, charset = (None, None) if refused else decoded(content or b"", kind)
                page = None if refused else bool(re.search("html|xml", (kind or "").lower()) or re.match(r"\s*<(?:!doctype|html)", text, re.I))
                out.append((charset, page, None if text is None else _clean(text)))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.record_batch([batch["id"], batch["refused"], *columns], names=["id", "refused", "charset", "is_html", "text"])

    return rows.mapInArrow(run, "id long, refused string, charset string, is_html boolean, text string")


def captured(pages: DataFrame) -> DataFrame:
    """The accepted pages of a capture that hold text, which is cut at 300,000 characters."""
    return pages.withColumn("text", F.substring("text", 1, SHOWN)).filter(F.regexp_replace("text", r"\s+", "") != "")
