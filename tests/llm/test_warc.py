import base64
import hashlib

import pytest

from tessera.llm import common, warc

from .fixtures import rows

PAGES = "page_id long, url string, html string, sha256 string, payload string, record string"


def pages(spark):
    data = [(1, "http://a.example/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b.example/\r\nWARC-Type: evil", "é" * 50_000), (4, "u", None), (5, "u", ""), (6, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "only here"), (7, "r", "rep"), (7, "r", "rep")]
    return spark.createDataFrame([(*x, "s", "p", "r") for x in data], PAGES).repartition(3)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, least):
    path = common.scratch(spark)
    warc.write_archive(pages(spark), path, least)
    got = rows(warc.read_archive(spark, path).select("page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert len(got) == 10
    data = [(r["page_id"], (r["html"] or "").encode()) for r in rows(pages(spark))]
    assert sorted((str(r["page_id"]), bytes(r["payload"])) for r in got) == sorted((str(p), b) for p, b in data)
    first = {}
    for p, b in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(b, p)
    for r in got:
        b = bytes(r["payload"])
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        if len(b) < least or (r["page_id"] == first[b] and r["page_id"] != 7):
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        elif r["page_id"] != 7:
            assert (r["record_type"], r["refers_to"]) == ("revisit", first[b])
    if not least:
        assert sorted(r["record_type"] for r in got if r["page_id"] == 7) == ["response", "revisit"]


def test_payloads_are_stored_once_and_records_are_whole(spark):
    path = common.scratch(spark)
    warc.write_archive(pages(spark), path)
    assert warc.payloads(spark, path).count() == len({r["html"] or "" for r in rows(pages(spark))})
    for r in rows(warc.records(spark, path)):
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and head.count(b"\r\nWARC-Type:") == 1
        assert int(head.rpartition(b"Content-Length: ")[2]) == len(rest) - 4


def test_a_changed_payload_is_noticed(spark):
    path = common.scratch(spark)
    warc.write_archive(pages(spark), path)
    bad = common.scratch(spark)
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "concat(payload, cast('!' as binary)) as payload").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(spark, bad).collect()


def test_empty_table(spark):
    path = common.scratch(spark)
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert rows(warc.read_archive(spark, path)) == []
