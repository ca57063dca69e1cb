"""E-mail in RFC 5322 text: headers, hops, verdicts of checks and discrepancies as expressions; the tree of parts in Python over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

HEAD, MAX_PARTS, MAX_DEPTH, MAX_ATTACHMENT = 8192, 200, 12, 8 * 1024 * 1024


def looks_like_mail(raw: Column) -> Column:
    head = F.split(F.substring(raw, 1, HEAD), "\r?\n\r?\n", 2)[0]
    return head.rlike(r"(?im)^(?:received|from|to|subject|date|message-id|return-path|mime-version)\s*:")


def headers(mails: DataFrame) -> DataFrame:
    """mail_id, pos, name (lower case), value: unfolded, repeated names kept."""
    head = F.regexp_replace(F.split("raw", "\r?\n\r?\n", 2)[0], r"\r?\n[ \t]+", " ")
    rows = mails.select("mail_id", F.posexplode(F.split(head, "\r?\n")).alias("pos", "line")).filter(F.col("line").rlike(r"^[!-9;-~]+\s*:"))
    return rows.select("mail_id", "pos", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))


def address(v: Column) -> Column:
    """struct(display, address, domain)."""
    inner = F.regexp_extract(v, "<([^>]*)>", 1)
    addr = F.trim(F.when(inner != "", inner).otherwise(v))
    display = F.when(inner != "", F.trim(F.regexp_replace(F.regexp_replace(v, "<[^>]*>", ""), '^\\s*"|"\\s*$', ""))).otherwise("")
    return F.struct(display.alias("display"), F.when(F.contains(addr, F.lit("@")), addr).otherwise("").alias("address"), F.lower(F.regexp_extract(addr, "@([^@]*)$", 1)).alias("domain"))


_V4 = P.java(P.TYPES["ipv4"])


def hops(h: DataFrame) -> DataFrame:
    """mail_id, step, from, ip, by, with, for, at, delay_s: the way in the order of travel, which is the reverse of the headers'."""
    own = h.filter("name = 'received'").withColumn("v", F.trim(F.regexp_replace("value", r"\s+", " ")))
    body = F.when(F.contains(F.col("v"), F.lit(";")), F.regexp_extract("v", "^(.*);[^;]*$", 1)).otherwise(F.col("v"))
    stamp = F.regexp_replace(F.regexp_replace(F.regexp_extract("v", r";([^;]*)$", 1), r"^\s*[A-Za-z]{3},\s*|\s*\([^)]*\)\s*$", ""), r"^\s+|\s+$", "")
    own = own.withColumn("body", body).withColumn("at", F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")))
    before = F.when(F.lower("body").rlike(r"\bby\s"), F.regexp_extract("body", r"(?i)^(.*?)\bby\s", 1)).otherwise(F.col("body"))
    from_ = F.regexp_extract("body", r"(?i)\bfrom\s+([^\s;()]+)", 1)
    in_brackets = F.array_join(F.regexp_extract_all(before, F.lit(r"\(([^)]*)\)"), F.lit(1)), " ")
    v6 = F.regexp_extract(in_brackets, P.java(P.TYPES["ipv6"]), 0)
    ip = F.coalesce(*[F.nullif(x, F.lit("")) for x in (F.regexp_extract(in_brackets, _V4, 0), v6, F.regexp_extract(before, _V4, 0), F.regexp_extract(from_, _V4, 0))], F.lit(""))
    w = Window.partitionBy("mail_id").orderBy(F.desc("pos"))
    gap = (F.unix_micros("at") - F.unix_micros(F.lag("at").over(w))) / 1e6
    return own.select(
        "mail_id", F.row_number().over(w).alias("step"), F.regexp_replace(from_, r"^\[|\]$", "").alias("from"), ip.alias("ip"), F.regexp_extract("body", r"(?i)\bby\s+([^\s;()]+)", 1).alias("by"),
        F.regexp_extract("body", r"(?i)\bwith\s+([A-Za-z0-9/._-]+)", 1).alias("with"), F.regexp_extract("body", r"(?i)\bfor\s+<([^>]+)>", 1).alias("for"), "at", F.round(gap).cast("long").alias("delay_s"),
    )


def checks(h: DataFrame) -> DataFrame:
    """mail_id, method, result of sender checks, each pair once."""
    auth = h.filter("name = 'authentication-results'").select("mail_id", F.explode(F.regexp_extract_all("value", F.lit(r"(?i)\b(?:spf|dkim|dmarc|arc|compauth)\s*=\s*[a-z]+"), F.lit(0))).alias("x"))
    auth = auth.select("mail_id", F.lower(F.trim(F.split("x", "=")[0])).alias("method"), F.lower(F.trim(F.split("x", "=")[1])).alias("result"))
    spf = h.filter("name = 'received-spf'").select("mail_id", F.lit("spf").alias("method"), F.lower(F.regexp_extract("value", r"^\s*([A-Za-z]+)", 1)).alias("result")).filter("result <> ''")
    return auth.unionByName(spf).distinct()


def discrepancies(h: DataFrame) -> DataFrame:
    """mail_id, what: senders whose base domains differ, another address in the display name, no way at all."""
    one = h.groupBy("mail_id").agg(*[F.max(F.when(F.col("name") == n, F.struct((-F.col("pos")).alias("o"), "value")))["value"].alias(c) for n, c in (("from", "f"), ("return-path", "rp"), ("reply-to", "rt"), ("message-id", "mid"))], F.count_if(F.col("name") == "received").alias("hops"))
    dom = lambda c: T.base_domain(address(F.coalesce(F.col(c), F.lit("")))["domain"])
    sender = dom("f")
    differs = lambda c: (sender != "") & (dom(c) != "") & (sender != dom(c))
    display = address(F.coalesce(F.col("f"), F.lit("")))["display"]
    shown = T.base_domain(F.lower(F.regexp_extract(display, r"@([A-Za-z0-9.-]+)", 1)))
    what = F.array_compact(F.array(
        F.when(differs("rp"), "return path"), F.when(differs("rt"), "reply to"), F.when(differs("mid"), "message id"), F.when((shown != "") & (shown != sender), "display name"), F.when(F.col("hops") == 0, "no received"),
    ))
    return one.select("mail_id", F.explode(what).alias("what"))


def _quoted(text: str) -> bytes:
    text = re.sub(r"=\r?\n", "", text)
    return b"".join(bytes([int(m[1], 16)]) if m[1] else m[0].encode("utf-8", "surrogatepass") for m in re.finditer(r"=([0-9A-Fa-f]{2})|.", text, re.S))


def _base64(text: str) -> bytes:
    clean = re.sub(r"[^A-Za-z0-9+/=]", "", text).rstrip("=")
    return base64.b64decode(clean + "=" * (-len(clean) % 4)) if len(clean) % 4 != 1 else b""


def _decoded(data: bytes, charset: str) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("cp1252", "replace")


def header_text(value: str) -> str:
    """A header with its encoded words decoded; neighbours are joined first."""
    def word(m: re.Match) -> str:
        data = _base64(m[3]) if m[2] in "Bb" else _quoted(m[3].replace("_", " "))
        return _decoded(data, m[1].lower()) or m[0]

    return re.sub(r"=\?([\w.:-]+)\?([BbQq])\?([^?]*)\?=", word, re.sub(r"(\?=)[ \t]+(=\?)", r"\1\2", value), flags=re.A)


def parameter(value: str, name: str) -> str:
    m = re.search(rf'{name}\s*=\s*(?:"([^"]*)"|([^;\s]+))', value, re.I)
    return (m[1] if m[1] is not None else m[2]) if m else ""


def attachment_name(*fields: str) -> str:
    """The name of a part: numbered pieces joined, percent-encoded with a character set, or plain."""
    for value in filter(None, fields):
        pieces = sorted((int(m[1]), m[2].strip().strip('"')) for m in re.finditer(r"(?:filename|name)\*(\d+)\*?\s*=\s*([^;]+)", value, re.I))
        single = re.search(r"(?:filename|name)\*\s*=\s*([^;]+)", value, re.I)
        joined = "".join(v for _, v in pieces) or (single[1].strip().strip('"') if single else "")
        if joined:
            m = re.match(r"([\w-]*)'[^']*'(.*)$", joined, re.A | re.S)
            return _decoded(_quoted(m[2].replace("%", "=")), (m[1] or "utf-8").lower()) if m else header_text(joined)
        plain = parameter(value, "filename") or parameter(value, "name")
        if plain:
            return header_text(plain)
    return ""


class Parts:
    """A message's texts, attachments and nested messages."""

    def __init__(self, raw: str, nested: int = 1):
        self.texts: list[str] = []
        self.attachments: list[tuple] = []
        self.nested: list[Parts] = []
        self.problems: list[str] = []
        self.depth = nested
        head, body = self.cut(raw)
        self.head = head
        self.walk(head.get("content-type", "text/plain"), head.get("content-transfer-encoding", ""), "", body, 0)

    @staticmethod
    def cut(raw: str) -> tuple[dict[str, str], str]:
        head, _, body = raw.replace("\r\n", "\n").partition("\n\n")
        out: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
            name, colon, value = line.partition(":")
            if colon:
                out.setdefault(name.strip().lower(), value.strip())
        return out, body

    def walk(self, kind: str, encoding: str, disposition: str, body: str, level: int) -> None:
        low = (kind or "text/plain").lower()
        if level > MAX_DEPTH:
            self.problems.append("too deep")
        elif low.startswith("multipart/"):
            mark = parameter(kind, "boundary")
            if not mark:
                self.problems.append("no boundary")
                return
            for part in self.split(body, mark):
                head, inner = self.cut(part)
                self.walk(head.get("content-type", ""), head.get("content-transfer-encoding", ""), head.get("content-disposition", ""), inner, level + 1)
        elif low.startswith("message/rfc822"):
            if self.depth:
                self.nested.append(Parts(body, self.depth - 1))
            else:
                self.problems.append("nested message not read")
        else:
            name = attachment_name(disposition, kind)
            code = (encoding or "").strip().lower()
            data = _base64(body) if code == "base64" else _quoted(body) if code == "quoted-printable" else body.encode("utf-8", "surrogatepass")
            if not name and "attachment" not in disposition.lower() and low.startswith("text/"):
                self.texts.append(_decoded(data, parameter(kind, "charset").lower()).strip())
            else:
                small = len(data) <= MAX_ATTACHMENT
                self.attachments.append((name or "(no name)", low.split(";")[0].strip(), len(data), *((getattr(hashlib, h)(data).hexdigest() if small else None) for h in ("md5", "sha1", "sha256"))))

    @staticmethod
    def split(body: str, mark: str) -> list[str]:
        parts, now = [], None
        for line in body.split("\n"):
            if line.rstrip() in (f"--{mark}", f"--{mark}--"):
                if now is not None:
                    parts.append("\n".join(now))
                now = [] if line.rstrip() == f"--{mark}" else None
                if len(parts) >= MAX_PARTS:
                    break
            elif now is not None:
                now.append(line)
        return parts

    def text(self, raw_head: str) -> str:
        """What extraction is to read: headers, the decoded subject, texts, attachment names, nested messages."""
        subject = header_text(self.head.get("subject", ""))
        own = [re.sub(r"\n[ \t]+", " ", raw_head), *([f"Subject-decoded: {subject}"] if subject else []), *self.texts, *(f"Attachment: {a[0]}" for a in self.attachments)]
        return "\n".join(own + [n.text("\n".join(f"{k}: {v}" for k, v in n.head.items())) for n in self.nested])


_ATTACHMENT = pa.struct([("name", pa.string()), ("type", pa.string()), ("bytes", pa.int64()), ("md5", pa.string()), ("sha1", pa.string()), ("sha256", pa.string())])
SCHEMA = "mail_id long, subject string, texts array<string>, attachments array<struct<name: string, type: string, bytes: long, md5: string, sha1: string, sha256: string>>, nested int, problems array<string>, text string"


def parsed(mails: DataFrame) -> DataFrame:
    """A row for each message: subject, texts, attachments with hashes, nested messages, problems, and the text to extract from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "type", "bytes", "md5", "sha1", "sha256"]
        for batch in batches:
            all_ = [Parts(r or "") for r in batch["raw"].to_pylist()]
            heads = [(r or "").replace("\r\n", "\n").partition("\n\n")[0] for r in batch["raw"].to_pylist()]
            columns = [
                batch["mail_id"], pa.array([header_text(p.head.get("subject", "")) for p in all_], pa.string()), pa.array([p.texts for p in all_], pa.list_(pa.string())),
                pa.array([[dict(zip(names, a, strict=True)) for a in p.attachments] for p in all_], pa.list_(_ATTACHMENT)), pa.array([len(p.nested) for p in all_], pa.int32()), pa.array([p.problems for p in all_], pa.list_(pa.string())),
                pa.array([p.text(h) for p, h in zip(all_, heads, strict=True)], pa.string()),
            ]
            yield pa.record_batch(columns, names=["mail_id", "subject", "texts", "attachments", "nested", "problems", "text"])

    return mails.selectExpr("cast(mail_id as long) as mail_id", "raw").mapInArrow(run, SCHEMA)
