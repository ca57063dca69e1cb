"""Pages by their tree, answers, settings, redirect chains and addresses at their edges."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph, keeping, noise, settings
from tessera.sources import pages


def rows(df):
    return [tuple(r) for r in df.collect()]


def text(html):
    return pages.read_page(html)[1]


def test_roots_and_furniture():
    pad = "w" * 400
    assert text(f"<body><main>m{pad}</main><article>a{pad}</article>") == f"\na{pad}"
    assert text(f"<noscript><article>no</article></noscript><main>m{pad}</main>") == f"\nm{pad}"
    assert text(f"<head><title>T</title><style>x</style></head>b{pad}<div role=Navigation>n</div>") == f"T\nb{pad}"
    assert text(f"<article class='menu'>kept {pad}</article>") == f"\nkept {pad}"
    assert text(f"<body class='nav-open'>kept {pad}<p class=submenu>too</p><p class='a menu'>gone</p>") == f"\nkept {pad}too\n"
    assert text(f"<body><p>a{pad}<p>b</body>") == f"\na{pad}b\n\n"
    assert text(f"<body>a &amp; b&nbsp;c{pad}<br>d<hr>e</body>") == f"\na & b\xa0c{pad}\nd\ne"
    assert pages.read_page("<nav>only menu</nav>")[2] == ["furniture kept"]


def test_addresses_of_a_page():
    pad = "w" * 400
    page = f"<article>{pad}<a href=' JavaScript:x'>a</a><img src='data:x'><form action='/gone'></form><div data-url='u' href='h' href='second'></div><a href='#x'></a></article><a href=out>o</a>"
    assert text(page) == f"\n{pad}a\n\nh\nu"


def test_empty_and_broken_pages(spark):
    assert pages.read_page(None) == pages.read_page("") == ("", "\n", [])
    assert pages.read_page("</p></div><<<a <!-- x")[0] == ""
    assert len(pages.read_page("<div>" * 50_000 + "x")[1]) > 0 and pages.shown_text("<i>" * 50_000 + "x") == "x"
    assert pages.shown_text(None) == ""
    assert pages.shown_text("<div style='visibility: hidden'>a<b style='visibility:visible'>b</b></div><p contenteditable=true>c<i>d</i></p><template><a href=x>e</a></template>") == "b"
    odd = spark.createDataFrame([(1, None, "x"), (None, "&#xD800;<p>a", "x"), (1, "", "x")], "page_id long, html string, text string")
    assert sorted(rows(pages.texts(odd).select("page_id", "title")), key=str) == [(1, ""), (1, ""), (None, "")]
    assert pages.shown(odd).count() == 3 and pages.texts(odd.limit(0)).count() == pages.shown(odd.limit(0)).count() == 0
    cut = spark.createDataFrame([(1, None), (2, "\n"), (3, "x" * 300_001)], "id long, text string")
    assert rows(pages.captured(cut).select("id", F.length("text"))) == [(3, 300_000)]


def test_charsets():
    assert pages.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == ("é", "iso-8859-1")
    assert pages.decoded(b"\xef\xbb\xbfa", None) == ("a", "utf-8")
    assert pages.decoded(b"<meta charset=no-such>\xff", None) == ("<meta charset=no-such>�", "utf-8")
    assert pages.decoded(b"<meta charset=rot13>a", None)[0] == "<meta charset=rot13>a"
    late = b" " * 2048 + b"charset=windows-1251 \xcf"
    assert pages.decoded(late, None)[1] == "utf-8" and pages.decoded(late[1:], None)[1] == "utf-8" and pages.decoded(late[30:], None)[1] == "windows-1251"


def test_refused_answers(spark):
    data = [(1, 200, None, None), (2, None, "text/html", b"x"), (3, 200, "text/html", b"x" * (5 * 1024 * 1024 + 1)), (4, 204, "application/zip", b"x"), (None, 200, "application/xhtml+xml", b"\xff")]
    got = {r["id"]: r for r in pages.answers(spark.createDataFrame(data, "id long, status int, content_type string, content binary")).collect()}
    assert [got[k]["refused"] for k in (1, 2, 3, 4, None)] == [None, "status none", "over 5 MB", "not a page: application/zip", None]
    assert got[1]["text"] == "" and got[None]["is_html"] and got[None]["text"] == "�" and got[3]["text"] is None


LINK = "ord long, url string, target string"


def test_chains_by_doubling(spark):
    rng = random.Random(5)
    for n, back in ((70, False), (33, True), (1, False)):
        data = [(k, f"u{k}", f"u{k + 1}") for k in range(n)] + ([(n, f"u{n}", "u7")] if back else [])
        data += [(1000 + k, f"v{k}", f"u{rng.randrange(n)}") for k in range(5)]
        rng.shuffle(data)
        moves = {u: t for _, u, t in data}
        want = set()
        for start in set(moves) - set(moves.values()):
            seen, at = [], start
            while at is not None and at not in seen:
                want.add((start, len(seen), at))
                seen.append(at)
                at = moves.get(at)
        got = rows(graph.chains(spark.createDataFrame(data, LINK)))
        assert len(got) == len(want) and set(got) == want
    only = spark.createDataFrame([(0, "a", "b"), (1, "b", "a"), (2, None, "c"), (3, "d", None), (4, "e", ""), (5, "f", "f")], LINK)
    assert rows(graph.chains(only)) == rows(graph.chains(only.limit(0))) == []


def test_a_repeated_address_takes_its_last_target(spark):
    data = [(0, "a", "old"), (1, "a", "new"), (1, "b", "a")]
    assert sorted(rows(graph.chains(spark.createDataFrame(data, LINK)))) == [("b", 0, "b"), ("b", 1, "a"), ("b", 2, "new")]


def test_settings_without_values(spark):
    plan = settings.Plan((settings.Feature("core", core=True, tab="c"), settings.Feature("a", tab="a"), settings.Feature("b", needs="c2"), settings.Feature("c2", needs="b")), {"p": ("a",), "q": ("a", "b")}, "p")
    df = spark.createDataFrame([(1, None), (2, {"a": None, "zz": True}), (3, {"a": True, "b": True, "c2": False})], "id long, flags map<string,boolean>")
    f = F.col("flags")
    got = {r["id"]: r for r in df.select("id", settings.matching(plan, f).alias("m"), settings.visible(plan, f).alias("v"), settings.switched_off(plan, f).alias("o"), settings.toggled(plan, f, F.lit("a"), F.lit(True)).alias("t"), settings.toggled(plan, f, F.lit("zz"), F.lit(True)).alias("u")).collect()}
    assert [got[k]["m"] for k in (1, 2, 3)] == ["свой", "свой", "q"]
    assert got[1]["v"] == ["c"] and got[3]["v"] == ["c", "a"] and got[3]["o"] == ["b", "c2"]
    assert got[1]["t"] == {"a": True} and got[1]["u"] is None and got[2]["t"] == {"a": True, "zz": True}
    raw = spark.createDataFrame([(None,), ("[1]",), ("null",), ('{"вид":"k","функции":7}',)], "raw string")
    out = [r["r"] for r in raw.select(settings.from_file(plan, "k", F.col("raw")).alias("r")).collect()]
    assert [r["error"] for r in out[:3]] == ["no settings"] * 3 and out[0]["flags"] is None


def test_addresses_of_counters_and_batches(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("hxxp://mc(.)yandex{.}ru/x", 3), ("notgoogle-analytics.com", 4), ("hotjar[точка]com", 5)], "url string, telemetry_id int")
    assert sorted(r["telemetry_id"] for r in noise.telemetry_urls(df).collect() if r["telemetry"]) == [3, 5]
    steps = spark.createDataFrame([(1, k) for k in range(6)] + [(2, 0)], "who long, id long")
    assert sorted(rows(keeping.batched(steps, ["who"], "id"))) == [(1, k, int(k == 5), 400 * int(k == 5)) for k in range(6)] + [(2, 0, 0, 0)]
