"""Files: their kind by their first bytes, texts of positioned items, web pages as text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD, JUNK, GAP = 512, 0.10, 0.25
# First bytes in hexadecimal and the kind that they mean, in order.
MAGIC = [
    ("255044462D", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("424D", "image"), ("504B0304", "archive"), ("504B0506", "archive"), ("52617221", "archive"), ("377ABCAF", "archive"),
    ("1F8B", "archive"), ("4D5A", "binary"), ("7F454C46", "binary"), ("D0CF11E0", "binary"),
]


def kind(content: Column) -> Column:
    """pdf, image, archive, binary or text: by signature, else binary if the head holds a zero byte or over a tenth control bytes."""
    head = F.substring(content, 1, HEAD)
    h = F.hex(head)
    out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image")
    for magic, name in MAGIC:
        out = out.when(h.startswith(magic), name)
    pairs = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    odd = F.size(F.filter(pairs, lambda b: b.rlike("^(?:0[0-8EF]|1.|7F)$")))
    return out.when(F.array_contains(pairs, "00") | (odd > JUNK * F.octet_length(head)), "binary").otherwise("text")


def read(spark: SparkSession, path: str, most: int = 50 * 1024 * 1024) -> DataFrame:
    """path, length, kind, text of files; only files of text are decoded, and larger ones than `most` aren't read."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    k = kind(F.col("content"))
    return files.select("path", "length", k.alias("kind"), F.when(k == "text", F.decode("content", "UTF-8")).alias("text"))


def item_text(items: DataFrame) -> DataFrame:
    """doc_id, page, text from positioned items (doc_id, page, ord, str, x, width, height, eol): a line end after a line's last item, a blank
    where the gap to the item before is over a quarter of its height and neither side has one."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    before, end = F.lag("str").over(w), F.lag(F.col("x") + F.col("width")).over(w)
    wide = (F.col("x") - end > GAP * F.greatest("height", F.lag("height").over(w))) & ~before.rlike(r"\s$") & ~F.col("str").rlike(r"^\s") & (F.col("str") != "")
    part = F.concat(F.when(~F.coalesce(F.lag("eol").over(w), F.lit(True)) & F.coalesce(wide, F.lit(False)), " ").otherwise(""), F.col("str"), F.when(F.col("eol"), "\n").otherwise(""))
    rows = items.withColumn("part", part)
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "").alias("text"))


_DROP = r"(?is)<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|div|section|article|main|li|ul|ol|table|tr|h[1-6]|blockquote|pre|header|footer|nav|aside|form|br|hr)\b[^>]*>"
_CHROME = r"(?is)<(nav|footer|aside|form|header)\b[^>]*>.*?</\1\s*>"


def page_text(html: Column, links: bool = True) -> Column:
    """The text of a web page by expressions: scripts dropped, furniture dropped unless most of the text goes with it, link targets
    appended to their place, a line for each block. llm/html.py has the full tree; this serves extraction."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), _DROP, " ")
    root = F.regexp_extract(body, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    root = F.when(root != "", root).otherwise(F.regexp_replace(body, r"(?is)^.*?<body\b[^>]*>", ""))
    plain = lambda x: F.length(F.regexp_replace(x, "<[^>]*>", ""))
    bare = F.regexp_replace(root, _CHROME, " ")
    kept = F.when(plain(bare) >= 0.4 * plain(root), bare).otherwise(root)
    if links:
        kept = F.regexp_replace(kept, r"""(?is)<[a-z][^>]*?\s(?:href|src|data-url|action)\s*=\s*["']((?:https?:)?//[^"']*)["'][^>]*>""", "$0 $1 ")
    text = F.regexp_replace(F.regexp_replace(kept, _BLOCK, "\n"), "<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_EMBEDDED = re.compile(r"""<script[^>]*type=["']application/(?:ld\+)?json["'][^>]*>(.*?)</script>""", re.I | re.S)
_MARKUP = re.compile(r"<[^>]+>|&nbsp;")
#: Strings of a page, and visited values of a script, at most: the fallback's own limits.
STRINGS, VALUES = 400, 200_000


def embedded_strings(html: str | None, least: int = 80) -> list[str]:
    """The long strings of a page's embedded JSON without markup, each once; the last member of a list or object comes first."""
    found: dict[str, None] = {}
    left = STRINGS
    for script in _EMBEDDED.finditer(html or ""):
        try:
            waiting = [json.loads(script[1])]
        except (ValueError, RecursionError):
            continue
        for _ in range(VALUES):
            if not waiting or not left:
                break
            value = waiting.pop()
            if isinstance(value, str):
                if len(value) >= least:
                    found[_MARKUP.sub(" ", value)] = None
                    left -= 1
            elif isinstance(value, (list, dict)):
                waiting.extend(value.values() if isinstance(value, dict) else value)
    return list(found)


def embedded_text(pages: DataFrame, least: int = 80) -> DataFrame:
    """page_id, text of the JSON that pages carry in scripts, for pages whose text scripts draw; empty where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(embedded_strings(h.as_py(), least)).encode("utf-8", "replace").decode() for h in batch["html"]]
            yield pa.record_batch([batch["page_id"], pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string")
