"""Rows made for one rule each, for operators whose SQL twin covers only part of them."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import attack, exports, graph, lists, noise, ranges, registry, stores, timeline
from tessera.plans import source_queries
from tessera.sources import files, har, mail
from tessera.streaming import run, state


def rows(df):
    return [r.asDict() for r in df.collect()]


T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENT = "case_id long, ord long, t timestamp, kind string, value string, source string, count long, from string, to string"


def events(spark, data):
    return spark.createDataFrame([(1, k, T0 + dt.timedelta(seconds=s), kind, v, v, n, a, b) for k, (s, kind, v, n, a, b) in enumerate(data)], EVENT)


LOG = [
    (0, "ioc.added", "a", 2, None, None), (120, "ioc.added", "a", 3, None, None), (240.001, "ioc.added", "a", 1, None, None), (241, "ioc.added", "b", 1, None, None), (250, "verdict.set", "x", 0, "unknown", "clean"),
    (260, "verdict.set", "x", 0, "clean", "unknown"), (261, "ioc.added", "b", 4, None, None), (400, "export.done", "", 0, None, None),
]


def test_folded_log_and_its_plain_form(spark):
    got = [(r["kind"], r["count"]) for r in sorted(rows(timeline.folded(events(spark, LOG))), key=lambda r: r["n"])]
    log = state.Log()
    for s, kind, v, n, a, b in LOG:
        log.append({"t": s, "kind": kind, "value": v, "source": v, "count": n, "from": a, "to": b})
    assert got == [(e["kind"], e["count"]) for e in log.events] == [("ioc.added", 5), ("ioc.added", 1), ("ioc.added", 5), ("export.done", 0)]


def test_cap_applied_twice():
    log = state.Log()
    for k in range(10):
        log.append({"t": k, "kind": f"k{k}"}, 5)
    assert [e["kind"] for e in log.events] == [timeline.TRUNCATED, "k6", "k7", "k8", "k9"] and log.events[0]["n"] == 6


def test_unsaved_is_independent_of_order(spark):
    now = F.lit(T0 + dt.timedelta(hours=3))
    data = events(spark, [(0, "ioc.added", "a", 1, None, None), (10, "export.done", "", 0, None, None), (20, "note.set", "a", 0, None, None), (15, "verdict.set", "a", 0, None, None)])
    one, two = rows(timeline.unsaved(data, now)), rows(timeline.unsaved(data.orderBy(F.desc("ord")), now))
    assert one == two and one[0]["changes"] == 2 and one[0]["remind"] and not one[0]["urgent"]
    assert rows(timeline.unsaved(data.filter("kind = 'export.done'"), now))[0]["remind"] is False


def test_triage_boundaries(spark):
    seen = T0 + dt.timedelta(days=40)
    found = spark.createDataFrame([(1, k, "domain", f"D{k % 305}", seen) for k in range(310)], "queue long, ord long, type string, value string, seen timestamp")
    gone = spark.createDataFrame([(1, "domain|d0", seen - dt.timedelta(days=29)), (1, "domain|d1", seen - dt.timedelta(days=31))], "queue long, k string, t timestamp")
    case = spark.createDataFrame([(1, "domain", "d2")], "queue long, type string, value string")
    got = {r["k"]: r for r in rows(timeline.triaged(found, gone, case, F.lit(seen)))}
    assert len(got) == 300 and "domain|d0" not in got and "domain|d2" not in got and not {"domain|d1", "domain|d3", "domain|d4"} & set(got) and next(iter(got.values()))["dropped"] == 3


@pytest.mark.parametrize(("cidr", "base", "error"), [("203.0.113.0/24", 3405803776, None), ("203.0.113.9/24", 3405803776, "not the start of the network"), ("1.2.3.4", 16909060, None), ("0.0.0.0/0", 0, None), ("1.2.3.04/8", None, "not an address"), ("1.2.3.4/33", None, "mask too long"), ("1.2.3.4/x", None, "mask is no number")])
def test_policy_ranges(spark, cidr, base, error):
    r = rows(ranges.parsed_v4(spark.createDataFrame([(cidr,)], "cidr string")))[0]
    assert (r["base"], r["error"]) == (base, error)


def test_range_edges(spark):
    policy = ranges.parsed_v4(spark.createDataFrame([(0, "203.0.113.0/31", "a"), (1, "203.0.113.2/32", "b"), (2, "203.0.113.0/24", "c"), (3, "0.0.0.0/0", "")], "ord int, cidr string, label string"))
    ips = spark.createDataFrame([(x,) for x in ("203.0.113.0", "203.0.113.1", "203.0.113.2", "203.0.113.3", "8.8.8.8", "no ip")], "ip string")
    got = {r["ip"]: r["own_mark"] for r in rows(ranges.owner(ips, policy))}
    assert got == {"203.0.113.0": "a", "203.0.113.1": "a", "203.0.113.2": "b", "203.0.113.3": "c", "8.8.8.8": "0.0.0.0/0", "no ip": None} | {"no ip": got["no ip"]}


@pytest.mark.parametrize(("host", "reason"), [("youtube.com", "platform"), ("m.YouTube.com", "platform"), ("notyoutube.com", None), ("youtube.com.evil.example", None), ("a.virustotal.com", "aggregator"), ("mc.yandex.ru", "telemetry"), ("yandex.ru", None), ("sub.own.example", "source")])
def test_noise_hosts(spark, host, reason):
    found = spark.createDataFrame([("domain", host), ("ipv4", "203.0.113.1")], "type string, value string")
    got = {r["value"]: r["noise_reason"] for r in rows(noise.classified(found, F.lit("own.example")))}
    assert got == {host: reason, "203.0.113.1": None}


def test_furniture_boundaries(spark):
    def doc(where, n=11):
        return "\n".join("Foot  ER" if k in where else f"line {k}" for k in range(n))

    data = [(1, doc({0, 3, 6})), (2, doc({0, 3, 5})), (3, doc({0, 9})), (4, "a\na\na\na\na"), (5, None), (6, "\n".join(f"k{k % 13}" for k in range(60)))]
    got = rows(noise.parts(spark.createDataFrame(data, "doc_id long, text string")).filter("part = 'furniture'"))
    assert sorted((r["doc_id"], r["pos"]) for r in got) == [(1, 0), (1, 3), (1, 6)]


def test_lines(spark):
    got = rows(noise.lines(spark.createDataFrame([(1, "a\r\n\nb\r\r\nc\r"), (2, None)], "doc_id long, text string")))
    assert [(r["doc_id"], r["pos"], r["line"], r["of"]) for r in got] == [(1, 0, "a", 4), (1, 1, "", 4), (1, 2, "b\r", 4), (1, 3, "c\r", 4), (2, 0, "", 1)]


def test_graph_parents_and_cycles(spark):
    items = spark.createDataFrame([(1, k, t, v, None, "") for k, (t, v) in enumerate([("domain", "a.b.example.com"), ("domain", "example.com"), ("domain", "b.example.com"), ("domain", "com"), ("ipv4", "203.0.113.5"), ("cidr", "203.0.113.0/29"), ("cidr", "0.0.0.0/0")])], "case_id long, ord long, type string, value string, verdict string, source string")
    got = {(r["from"], r["to"]) for r in rows(graph.edges(items))}
    assert got == {("a.b.example.com", "b.example.com"), ("b.example.com", "example.com"), ("203.0.113.5", "203.0.113.0/29"), ("203.0.113.5", "0.0.0.0/0")}
    links = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "c", "b"), (3, "x", "x"), (4, "y", "gone")], "ord long, url string, target string")
    walk = {}
    for r in sorted(rows(graph.chains(links)), key=lambda r: r["step"]):
        walk.setdefault(r["start"], []).append(r["url"])
    assert walk == {"a": ["a", "b", "c"], "y": ["y", "gone"]}


def test_har_limits(spark):
    data = [(1, "no json"), (2, "{}"), (3, '{"log":{}}'), (4, '{"log":{"entries":[]}}'), (5, '{"log":{"entries":[{"request":{"url":"https://a.example.com/x/y"},"response":{"status":301,"redirectURL":"z"}},null]}}'), (6, None)]
    hars = spark.createDataFrame(data, "har_id long, raw string")
    assert [r["s"] for r in rows(hars.orderBy("har_id").select(har.status(F.col("raw")).alias("s")))] == [None, None, "incomplete", "har", "har", None]
    got = rows(har.entries(hars))
    assert [(r["har_id"], r["n"], r["redirect"]) for r in got][0] == (5, 1, "https://a.example.com/x/z") and len(got) == 2
    long = spark.createDataFrame([("h" * 301,)], "v string").select(har.header(F.array(F.struct(F.lit("Server").alias("name"), F.col("v").alias("value"))), "server").alias("x"))
    assert rows(long)[0]["x"] == "h" * 300 + "…"


def test_mail_codecs():
    assert mail.header_text("=?windows-1251?B?z/Do4uXy?= =?UTF-8?Q?_=D0=B0?=") == "Привет а" and mail.header_text("=?koi8-r?B?8NLJ18XU?=") == "Привет" and mail.header_text("plain") == "plain"
    assert mail.attachment_name("attachment; filename*0*=UTF-8''a%20; filename*1=b.txt") == "a b.txt" and mail.attachment_name("", "x; name=plain.bin") == "plain.bin" and mail.attachment_name("attachment; filename*=UTF-8''%D0%B0.txt") == "а.txt"
    assert mail._quoted("a=3Db=\nc=zz") == b"a=bc=zz" and mail._base64("YW Jj") == b"abc"


def test_mail_tree():
    inner = "Subject: inner\nContent-Type: text/plain\n\nnested"
    raw = f'Subject: s\nContent-Type: multipart/mixed; boundary=b\n\nskip\n--b\nContent-Type: multipart/alternative; boundary="c"\n\n--c\nContent-Type: text/plain; charset=windows-1251\nContent-Transfer-Encoding: quoted-printable\n\n=CF=F0\n--c--\n--b\nContent-Type: message/rfc822\n\n{inner}\n--b--'
    p = mail.Parts(raw)
    assert p.texts == ["Пр"] and len(p.nested) == 1 and p.nested[0].texts == ["nested"] and p.attachments == []
    assert mail.Parts("Content-Type: multipart/mixed\n\nx").problems == ["no boundary"] and mail.Parts("").texts == [""]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    assert {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"]) for r in rows(files.read(spark, str(tmp_path)))} == {"a.txt": ("text", "plain"), "b.bin": ("binary", None)}
    html = "<html><body><nav><a href='https://n.example/'>n</a></nav><p>see <a href='https://a.example/x'>this</a> &amp; that</p><script>x</script></body></html>"
    assert rows(spark.createDataFrame([(html,)], "h string").select(files.page_text(F.col("h")).alias("t")))[0]["t"] == "see https://a.example/x this & that"


def test_exports(spark):
    schema = "case_id long, ord long, type string, value string, verdict string, verdict_source string, note string, tags array<string>, own boolean"
    data = [(1, 0, "domain", "e.example.com", "malicious", "lab", "n", ["t"], False), (1, 1, "url", "https://e.example.com/it's", None, None, None, None, False), (1, 2, "domain", "own.example.com", "malicious", None, None, None, True), (1, 3, "md5", "A" * 32, "suspicious", None, None, None, False), (1, 4, "cve", "CVE-2021-1", None, None, None, None, False), (1, 5, "ipv4", "203.0.113.1", "clean", None, None, None, False)]
    items = spark.createDataFrame(data, schema)
    rule = rows(exports.yara(items))[0]["rule"]
    assert rule.startswith('import "hash"') and '$s1 = "e.example.com"' in rule and "own.example.com" not in rule and "a" * 32 in rule
    assert {r["sid"] for r in rows(exports.suricata(items))} == {1_000_000, 1_000_001}
    sigma = {r["logsource"]: r["rule"] for r in rows(exports.sigma(items))}
    assert set(sigma) == {"dns", "proxy", "process_creation"} and "it''s" in sigma["proxy"]
    import json

    objects = json.loads(rows(exports.bundle(exports.stix(items, "2024-01-01T00:00:00.000Z")))[0]["bundle"])["objects"]
    assert [o["name"] for o in objects] == ["e.example.com", "https://e.example.com/it's", "own.example.com", "A" * 32] and objects[1]["pattern"] == "[url:value = 'https://e.example.com/it\\'s']"
    assert rows(exports.excluded(items)) == [{"case_id": 1, "value": "203.0.113.1"}]


def test_stores(spark):
    assert rows(stores.folded_functions(spark.createDataFrame([('{"executables":{"x":{}}}',)], "raw string"))) == [{"name": "x", "categories": []}]
    with pytest.raises(Exception, match="executables"):
        stores.folded_functions(spark.createDataFrame([("{}",)], "raw string")).collect()
    assert rows(spark.createDataFrame([(" B, a,, b ",)], "t string").select(lists.tags("t").alias("t")))[0]["t"] == ["b", "a"]
    assert attack.searched(spark.createDataFrame([("T1", "x")], "id string, name string"), "zz").count() == 0


def test_streams_match_batches(spark, tmp_path):
    seen = T0
    data = [(k % 2, k, "found" if k % 5 else "dismiss", f"d{k % 7}", seen + dt.timedelta(minutes=k)) for k in range(60)]
    spark.createDataFrame(data, "queue long, ord long, action string, k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {(r["queue"], r["k"]): r["n"] for r in rows(run.drained(state.triage(spark.readStream.schema("queue long, ord long, action string, k string, t timestamp").parquet(str(tmp_path / "in")))))}
    want = {}
    for q in (0, 1):
        items, gone = {}, set()
        for _, _, action, k, _ in (x for x in data if x[0] == q):
            if action == "dismiss":
                items.pop(k, None)
                gone.add(k)
            elif k not in gone:
                items[k] = items.get(k, 0) + 1
        want |= {(q, k): n for k, n in items.items()}
    assert got == want


def test_stream_without_a_cap_keeps_every_key(spark, tmp_path):
    data = [(q, k, "found", f"k{k % 400}", T0 + dt.timedelta(seconds=k)) for k in range(801) for q in (0, None)] + [(0, 801, "dismiss", "k1", T0), (0, 802, "dismiss", "k2", T0), (0, 803, "found", "k1", T0)]
    data += [(0, 804, "forget", None, T0), (0, 805, "found", "k1", T0), (0, 806, "found", "k2", T0), (0, 807, "take", "k3", T0), (0, 808, "found", None, T0), (None, 809, "dismiss", "k5", T0), (None, 810, "found", "k5", T0)]
    schema = "queue long, ord long, action string, k string, t timestamp"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda **more: rows(run.drained(state.triage(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), **more)))
    whole = {f"k{k}": 3 if k == 0 else 2 for k in range(400)}
    first = {k: n for k, n in whole.items() if k != "k3"} | {"k1": 1, "k2": 1, None: 1}
    second = {k: n for k, n in whole.items() if k != "k5"}
    for parts in (1, 8):
        got = read(cap=None, parts=parts)
        assert {r["dropped"] for r in got} == {0} and len(got) == len(first) + len(second)
        assert {(r["queue"], r["k"]): r["n"] for r in got} == {(0, k): n for k, n in first.items()} | {(None, k): n for k, n in second.items()}
    capped = read(cap=5)
    assert sum(r["queue"] == 0 for r in capped) == 5 and sum(r["queue"] is None for r in capped) == 5 and min(r["dropped"] for r in capped) > 0


def test_stream_query_counts_all_users(spark, tmp_path):
    at = lambda k: None if k % 50 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)
    data = [(k, at(k), None if k % 97 == 0 else 7 * (k % 350), "view", 1.0, "") for k in range(1000)]
    spark.createDataFrame(data, source_queries.EVENTS).coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*")).rename(tmp_path / "events.parquet")
    got = {(r["queue"], r["k"]): r["n"] for r in rows(source_queries.t2_stream_triage(spark, str(tmp_path)))}
    users = collections.Counter(u for _, _, u, *_ in data)
    assert got == {(None if u is None else u % 7, None if u is None else f"v{u}"): n for u, n in users.items()}


def test_capture_gate(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    data = [(1, 0, 1, "https://a", at(0)), (1, 1, 1, "https://a", at(0.5)), (1, 2, 2, "https://a", at(5)), (1, 3, 1, "https://b", at(6)), (1, 4, 1, "https://a", at(7)), (1, 5, 1, "https://a", at(7200))]
    schema = "session long, ord long, tab int, origin string, t timestamp"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = sorted(rows(run.drained(state.captures(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "append")), key=lambda r: r["ord"])
    assert [r["reason"] for r in got] == [None, "pause", "tab", "origin", None, "time"]


def test_deny_list_of_any_length(spark):
    hosts = spark.createDataFrame([(1, "www.YouTube.example"), (2, "a.internal"), (3, "fine.example"), (4, None), (5, ""), (6, "x" * 250 + "e9")], "id long, host string")
    denied = spark.createDataFrame([(f"none{k}",) for k in range(500)] + [("youtube",), (".INTERNAL",), ("",), (None,), ("e9",)], "entry string")
    assert sorted(r["id"] for r in rows(registry.deny_listed(hosts, denied))) == [1, 2, 6]
    assert rows(registry.deny_listed(hosts, denied.limit(0))) == []
