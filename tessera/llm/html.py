"""Extracts the main text of web pages.

Method: a site style tree. The pages of a host are merged by the paths of their branches (containers with tag, id and class; article and main too). A
branch's presentation importance is the entropy of its child layouts over the host's pages, its content importance falls with the entropy of its
texts' spread over them. Branches of low importance, the same on page after page, are removed from each page, unless they hold most of its text; one
that lies in the page's article only if at least half of the host's pages have it. Copies of a page on its host count once.

Besides, elements go that say what they are: by tag (nav, footer, aside, ...), role or hiding, and by name (class or id). A name counts only where
all parts of it are known words, never on html, body, article or main, never against the tree's evidence that a branch's text is its pages' own in the article,
and it does not take most of a page that has its text nowhere else. What lies inside a left out element is left out, articles as well.

The page's text is that of its articles and mains if they hold at least half of what is left, else all that is left. Blocks are the texts between
block elements; `br` is white space; what an inline element leaves out leaves its block whole.

Defined results: null html gives an empty text; pages without a host are merged with none; a repeated row is extracted again; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A host needs so many pages with a branch before the branch can be judged.
PAGES = 5
IMPORTANCE = 0.3
#: From here on a branch's text counts as each page's own.
OWN = 0.9
#: The share of presentation in a branch's importance.
PRESENTATION = 0.1

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre search section select summary table caption tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("aside article div dl figure footer form header main menu nav ol section table ul".split())
RAW = frozenset("script style noscript template iframe object svg canvas math title textarea select audio video noembed noframes xmp map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GONE = frozenset("nav footer aside button dialog menu search".split())
#: Roots of a page's own text; neither they nor html and body are judged by name.
ROOTS = frozenset(("article", "main"))
#: Named elements inside each other that a block asks.
NAMED = 8
#: Words of classes and ids that name what isn't the article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice newsletter subscribe subscription sidebar menu navbar nav navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations popup modal overlay widget widgets toolbar pagination pager masthead copyright "
    "login signin signup search alert skip".split()
)
#: Words that may stand beside those in a name and leave its meaning.
BESIDE = frozenset(
    "area bar block box btn button buttons bottom column container content footer form group header holder icon icons inner item items left link links list main module outer page panel placeholder post primary right section secondary "
    "site slot small sticky thread title top unit view wrap wrapper global mobile desktop".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Start tags that end an open element of these kinds (up to the nearest CONTAINER or root).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[^a-z]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: A block: its text, the innermost branch it lies in (-1: none), whether it lies in an article or main, and the elements that leave it out.
Block = tuple[str, int, bool, list[int]]


class Page:
    """What a page consists of, in plain lists: blocks; for branches, in order of their start, path, parent (-1: none), child layout and contents.

    A branch's contents are its own texts, and the numbers of the branches in it.
    What leaves a block out is 0 for an element that says what it is (tag, role, hidden), and a number of its own for each element with a telling name.
    named: by such a number, the branch that has the name, or -1.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.paths: list[int] = []
        self.parents: list[int] = []
        self.children: list[list[str]] = []
        self.contents: list[list[str | int]] = []
        self.named: list[int] = [-1]
        self._open: Counter[str] = Counter()
        # Pieces of the open block: text, and what leaves it out.
        self._text: list[tuple[str, tuple[int, ...]]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        # An open element: tag, what it is left out by, its innermost branch, inside article or main, its path.
        stack: list[tuple[str, tuple[int, ...], int, bool, int]] = [("", (), -1, False, 0)]
        at, match = 0, _TAG.search
        while at < len(source):
            m = match(source, at)
            if m is None:
                self._add(source[at:], stack[-1])
                break
            if m.start() > at:
                self._add(source[at : m.start()], stack[-1])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag, stack)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                end = len(source) if close is None else source.find(">", close.end())
                at = len(source) if end < 0 else end + (close is not None)
                if tag in BLOCK:
                    self._flush(stack[-1])
            else:
                self._start(tag, m[3] or m[6] or "", stack)
        self._flush(stack[-1])

    def _add(self, text: str, now: tuple) -> None:
        if now[0] != "head":
            self._text.append((text, now[1]))

    def _flush(self, now: tuple) -> None:
        """Ends the open block; what inline elements in it leave out becomes blocks of their own."""
        if not self._text:
            return
        pieces, self._text = self._text, []
        least = min((o for _, o in pieces), key=len)
        for out in dict.fromkeys([least, *(o for _, o in pieces)]):
            text = " ".join(entities.unescape("".join(t for t, o in pieces if o == out)).split())
            if text:
                self.blocks.append((text, now[2], now[3], list(out)))
                if now[2] >= 0:
                    self.contents[now[2]].append(text)

    def _start(self, tag: str, rest: str, stack: list) -> None:
        if tag in VOID:
            if tag == "br":
                self._add(" ", stack[-1])
            elif tag == "hr":
                self._flush(stack[-1])
            return
        if tag not in BLOCK:
            told, named = self._named(rest)[1:] if rest else (False, False)
            if tag == "button" or told or named:
                self._push(stack, tag, self._out(stack[-1][1], tag == "button" or told, named, -1), *stack[-1][2:])
            elif tag == "head":
                self._push(stack, tag, (0,), *stack[-1][2:])
            return
        self._flush(stack[-1])
        if tag == "body":
            while len(stack) > 1 and stack[-1][0] == "head":
                self._pop(stack, len(stack) - 1)
        if stack[-1][0] == "p" or any(e[0] == "p" for e in stack[-3:]):
            self._close_p(stack)
        for kind in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in kind if isinstance(kind, set) else stack[k][0] == kind:
                    self._pop(stack, k)
                    break
                if stack[k][0] in CONTAINER or stack[k][0] == "body":
                    break
        _, out, inside, root, path = stack[-1]
        name, told, named = self._named(rest) if rest.strip() else ("", False, False)
        path = xxhash.xxh3_64_intdigest(f"{path}/{tag}{name}".encode("utf-8", "surrogatepass")) >> 1
        if inside >= 0:
            self.children[inside].append(tag + name if tag in CONTAINER else tag)
        if tag in CONTAINER:
            self.paths.append(path)
            self.parents.append(inside)
            self.children.append([])
            self.contents.append([])
            if inside >= 0:
                self.contents[inside].append(len(self.paths) - 1)
            inside = len(self.paths) - 1
        if tag in ROOTS:
            out, root = self._out(out, told, False, -1), True
        elif tag not in ("html", "body"):
            out = self._out(out, told or tag in GONE or (tag == "header" and not root), named or tag == "form", inside if tag in CONTAINER else -1)
        self._push(stack, tag, out, inside, root, path)

    def _out(self, out: tuple[int, ...], told: bool, named: bool, branch: int) -> tuple[int, ...]:
        if told or 0 in out:
            return (0,)
        if not named or len(out) >= NAMED:  # of a long chain of named elements only the outermost are asked
            return out
        self.named.append(branch)
        return (*out, len(self.named) - 1)

    def _close_p(self, stack: list) -> None:
        for k in range(len(stack) - 1, max(0, len(stack) - 4), -1):
            if stack[k][0] == "p":
                self._pop(stack, k)
                return
            if stack[k][0] in BLOCK:
                return

    def _push(self, stack: list, *element) -> None:
        stack.append(element)
        self._open[element[0]] += 1

    def _pop(self, stack: list, k: int) -> None:
        """Closes the open elements from the k-th on."""
        self._open.subtract(e[0] for e in stack[k:])
        del stack[k:]

    def _end(self, tag: str, stack: list) -> None:
        if tag in BLOCK:
            self._flush(stack[-1])
        if not self._open[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if any(e[0] in BLOCK for e in stack[k + 1 :]):
                    self._flush(stack[-1])
                self._pop(stack, k)
                return
            if tag not in BLOCK and stack[k][0] in BLOCK:
                return
            if stack[k][0] in ROOTS and tag not in ("article", "main", "body", "html"):
                return

    @staticmethod
    def _named(rest: str) -> tuple[str, bool, bool]:
        """The id and class as part of a path, whether the element says that it isn't the article's, and whether its id or class names such a thing."""
        a = {k.lower(): v or w or x or "" for k, v, w, x in _ATTRIBUTE.findall(rest)}
        names = f"{a.get('id', '')} {a.get('class', '')}".split()
        named = any((p := [w for w in _PARTS.split(_CASE.sub("-", x).lower()) if w]) and not WORDS.isdisjoint(p) and all(w in WORDS or w in BESIDE or len(w) == 1 for w in p) for x in names)
        hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        label = "." + ".".join(sorted(x.lower() for x in names)) if names else ""
        return label, a.get("role", "").lower() in ROLES or hidden, named

    def features(self) -> dict[int, tuple[int, int]]:
        """By path: hashes of the layouts and of the contents of its branches on this page."""
        own = [0] * len(self.paths)
        layouts: dict[int, list[str]] = {}
        contents: dict[int, list[str]] = {}
        for k in range(len(self.paths) - 1, -1, -1):  # a branch's number is above its parent's
            own[k] = _hash64([x if isinstance(x, str) else f"\x00{own[x]}" for x in self.contents[k]])
        for k, path in enumerate(self.paths):
            layouts.setdefault(path, []).extend(self.children[k])
            contents.setdefault(path, []).append(str(own[k]))
        return {path: (_hash64(layouts[path]), _hash64(contents[path])) for path in layouts}

    def text(self, low: dict[int, bool] | None = None, own: set[int] | None = None) -> str:
        return text_of(self.blocks, self.paths, self.parents, self.named, low or {}, own or set())


def _hash64(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) >> 1


def text_of(blocks: list[Block], paths: list[int], parents: list[int], named: list[int], low: dict[int, bool], own: set[int]) -> str:
    """The page's text. low: the host's paths of low importance, and whether most pages have them; own: its paths whose text is each page's own."""
    blocks = [b for b in blocks if 0 not in b[3]]
    left = _without_named(blocks, paths, named, own)
    if low:
        total, share, outside = sum(len(b[0]) for b in left), [0] * len(paths), [0] * len(paths)
        for t, k, root, _ in left:
            if k >= 0:
                share[k] += len(t)
                outside[k] += 0 if root else len(t)
        for k in range(len(paths) - 1, -1, -1):
            if (up := parents[k]) >= 0:
                share[up] += share[k]
                outside[up] += outside[k]
        gone = [False] * len(paths)
        for k, path in enumerate(paths):
            gone[k] = (parents[k] >= 0 and gone[parents[k]]) or (path in low and 2 * share[k] <= total and (low[path] or outside[k] > 0))
        left = [b for b in left if b[1] < 0 or not gone[b[1]]]
    inner = [b for b in left if b[2]]
    if 2 * sum(len(b[0]) for b in inner) >= sum(len(b[0]) for b in left):
        left = inner
    return "\n".join(b[0] for b in left)


def _without_named(blocks: list[Block], paths: list[int], named: list[int], own: set[int]) -> list[Block]:
    """The blocks that no telling name leaves out: a name holds unless its element lies in an article and the tree finds its text to be each page's own, or it has most
    of the page's text and no article or main has text outside it."""
    held: dict[int, int] = {}
    roots: dict[int, int] = {}
    for t, _, root, names in blocks:
        for k in names:
            held[k] = held.get(k, 0) + len(t)
            roots[k] = roots.get(k, 0) + (len(t) if root else 0)
    total, rooted = sum(len(b[0]) for b in blocks), sum(len(b[0]) for b in blocks if b[2])
    void = {k for k, n in held.items() if 2 * n > total and roots[k] == rooted}
    void |= {k for k in held if named[k] >= 0 and paths[named[k]] in own and 2 * held[k] > total}
    return [b for b in blocks if void.issuperset(b[3])]


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, d1 and d2 (digest of the page), page (blocks, paths and names as JSON), branches (path, style, feature): each page is read once."""
    kind = "page_id long, url string, host string, d1 long, d2 long, page string, branches array<struct<path: long, style: long, feature: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, one, two, held = [], [], [], []
            for source in batch["html"]:
                own = source.as_py() or ""
                digest = xxhash.xxh3_128_intdigest(own.encode("utf-8", "surrogatepass"))
                one.append(digest >> 65)
                two.append(digest & (1 << 63) - 1)
                page = Page(own)
                held.append(json.dumps((page.blocks, page.paths, page.parents, page.named), ensure_ascii=False, separators=(",", ":")))
                found.append([{"path": p, "style": x, "feature": y} for p, (x, y) in {0: (0, one[-1]), **page.features()}.items()])
            listed = pa.list_(pa.struct([(x, pa.int64()) for x in ("path", "style", "feature")]))
            columns = [batch["page_id"], batch["url"], batch["host"], pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(held, pa.string()), pa.array(found, listed)]
            yield pa.record_batch(columns, names=["page_id", "url", "host", "d1", "d2", "page", "branches"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    return own.mapInArrow(run, kind)


def branches(pages: DataFrame) -> DataFrame:
    """host, path, style, feature: a row for each path of each distinct page of a known host (path 0: the page itself); copies of a page are no repetition."""
    once = pages.filter("host <> ''").select("host", "d1", "d2", "branches").dropDuplicates(["host", "d1", "d2"])
    return once.select("host", F.inline("branches"))


def importance(rows: DataFrame) -> DataFrame:
    """host, path, n, importance of each branch of the merged trees.

    Presentation: the entropy of the branch's layouts to the base n. Content: 1 less the mean over its texts of log_n of how many of the
    n branches carry the text (the entropy of an even spread). Both are sums over counts, so a host with most of the pages collapses early.
    """
    key = ["host", "path"]
    layouts = rows.groupBy(*key, "style").agg(F.count("*").alias("c")).groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("l"))
    texts = rows.groupBy(*key, "feature").agg(F.count("*").alias("c")).groupBy(*key).agg(F.count("*").alias("kinds"), F.sum(F.log("c")).alias("t"))
    n = F.log("n")
    presentation = 1 - F.col("l") / F.col("n") / n
    content = 1 - F.col("t") / F.col("kinds") / n
    both = layouts.filter(F.col("n") > 1).join(texts, key)
    return both.select(*key, "n", (PRESENTATION * presentation + (1 - PRESENTATION) * content).alias("importance"))


def verdicts(rows: DataFrame) -> DataFrame:
    """host, judged: of each host the paths that the tree has an opinion on, with `low` and `most` (at least half of the host's pages have it)."""
    rated = importance(rows).filter(F.col("n") >= PAGES)
    size = rows.filter("path = 0").groupBy("host").agg(F.count("*").alias("pages"))
    low = F.col("importance") < IMPORTANCE
    own = rated.filter("path <> 0").filter(low | (F.col("importance") >= OWN)).join(size, "host").select("host", "path", low.alias("low"), (2 * F.col("n") >= F.col("pages")).alias("most"))
    return own.groupBy("host").agg(F.collect_list(F.struct("path", "low", "most")).alias("judged"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    read = common.save(parsed(pages))
    judged = common.save(verdicts(branches(read)))
    judged = judged.select(F.col("host").alias("_host"), "judged")
    judged = common.small(judged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known, held = [], None, ({}, set())
            for page, found in zip(batch["page"], batch["judged"], strict=True):
                found = found.as_py() or []
                if found != known:
                    known, held = found, ({x["path"]: x["most"] for x in found if x["low"]}, {x["path"] for x in found if not x["low"]})
                texts.append(text_of(*json.loads(page.as_py()), *held))
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = read.select("page_id", "url", "host", "page").join(judged, F.col("host") == F.col("_host"), "left")
    return joined.select("page_id", "url", "page", "judged").mapInArrow(run, "page_id long, url string, text string, n_chars long")
