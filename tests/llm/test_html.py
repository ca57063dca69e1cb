from tessera.llm import html

from .fixtures import rows

PAGES = "page_id long, url string, html string, host string, removed string, text string"


def text(source):
    return html.Page(source).text()


def test_blocks_references_and_blanks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><li>m</li></nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four&nbsp;five<p>six &lt;7&gt; 8 < 9<script>var a='</p>'</script><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table></article><footer>f</footer></body>"
    assert text(page) == "A & B\none two three four five\nsix <7> 8 < 9\nx\ny\nc1\nc2"


def test_what_is_not_the_article_goes():
    inside = "".join(f"<div class='{c}'>no</div>" for c in ("ad", "share-buttons", "cookie-notice", "comments", "sidebar left")) + "<form>no<input></form><aside>no</aside><div style='display: none'>no</div><div role='navigation'>no</div>"
    assert text(f"<body><header>no</header><div>no</div><main><p>yes</p>{inside}<header><h2>head</h2></header></main><div id='footer'>no</div>") == "yes\nhead"


def test_a_name_does_not_take_the_page():
    for page in (
        "<article class='post category-social'><p>yes</p></article>", "<article class='post has-comments'><p>yes</p></article>", "<body class='has-sidebar'><p>yes</p></body>", "<body class='menu'><p>yes</p></body>",
        "<div class='content-with-sidebar'><p>yes</p></div>", "<html class='nav-open'><body><p>yes</p></body></html>", "<main class='search'><p>yes</p></main>", "<article class='promo'><p>yes</p></article>", "<div id='comments'><p>yes</p></div><div class='ad'>no</div>",
    ):
        assert text(page) == "yes"


def test_broken_pages():
    assert text("") == text("   ") == text("<!-- never ends") == ""
    assert text("<p>cut off <b>here") == "cut off here"
    assert text("<article><p>a</p><div class=x>b<p>c</article>") == "a\nb\nc"
    assert text("<div class='ad'>no<article><p>yes</p></article>") == "yes"
    assert text("a <b") == "a"
    assert len(text("<article>" + "<p>w</p>" * 50_000)) == 99_999


def test_articles_inside_what_is_left_out_stay_out():
    assert text("<article><p>The story itself</p></article><section id='comments'><article>Reader says hi</article></section>") == "The story itself"
    assert text("<article><p>Short</p></article><section id='comments'><article>Reader says hi at length, and says it again and again</article></section>") == "Short"
    assert text("<main><p>The story itself</p><aside><article>Related card</article></aside></main>") == "The story itself"
    assert text("<nav><article>menu</article></nav><p>text</p>") == "text"


def test_names_that_only_hold_a_known_word():
    assert text("<body class='right-sidebar'><p>all</p></body>") == text("<article class='post comments-open'><p>all</p></article>") == "all"
    assert text("<p>one</p><table class='share-price-table'><tr><td>4.20</table><p>two</p><p>three is longer</p>") == "one\n4.20\ntwo\nthree is longer"
    assert text("<p>one and more</p><div class='post-comments'>no</div><div class='shareButtons'>no</div><div class='ad-300x250'>no</div>") == "one and more"


def test_text_outside_a_card_stays():
    assert text("<p>" + "the page's own words " * 9 + "</p><article>card</article>").endswith("words\ncard")


def test_inline_elements_leave_their_block_whole():
    assert text("<p>Press the <label>blue</label> button <span class='ad'>buy now</span>to start <button>ok</button>again</p>") == "Press the blue button to start again"


def test_deep_and_long_pages_take_time_in_proportion():
    deep = "<div>" * 30_000 + "w" + "</div>" * 30_000
    assert text(deep) == "w" and len(html.Page(deep).features()) == 30_000
    assert text("<div>" * 20_000 + "w" + "</section>" * 20_000) == "w"


def test_the_tree_decides_where_names_say_nothing(spark):
    def page(k, host, box="A box of the same words on each page"):
        story = f"<p>Text number {k} with some {k * 7} words of its own, and long enough to be the page</p>"
        return (k, f"http://{host}/{k}", f"<body><article><div class='x9'><p>{box}</p></div>{story}<div class='q'><p>part {k} differs</p></div></article></body>", "h", "r", "t")

    data = [page(k, "h.example") for k in range(8)] + [page(100 + k, "other.example") for k in range(3)] + [page(200 + k, "some.example", "twice" if k < 6 else f"own {k}") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in rows(html.extract(spark.createDataFrame(data, PAGES).repartition(3)))}
    own = lambda k: f"Text number {k} with some {k * 7} words of its own, and long enough to be the page\npart {k} differs"
    assert got[3] == own(3)
    assert got[101] == "A box of the same words on each page\n" + own(101)  # too few pages to judge
    assert got[203] == "twice\n" + own(203)  # six of twenty pages share it: no furniture of the host


def test_branches_that_repeat_on_a_host_go(spark):
    def page(k, host="h.example"):
        return (k, f"http://{host}/{k}", f"<body><div class='top'><p>Same words on each page</p></div><div class='body'><p>Text number {k} with some {k * 7} words that are its own and long enough</p></div></body>", "h", "r", "t")

    pages = spark.createDataFrame([page(k) for k in range(8)] + [page(100, "other.example"), (200, None, None, None, None, None), (201, "no host", "<p>x</p>", "", "", ""), page(0)], PAGES).repartition(3)
    got = {r["page_id"]: r for r in rows(html.extract(pages))}
    assert got[3]["text"] == "Text number 3 with some 21 words that are its own and long enough"
    assert got[100]["text"].startswith("Same words on each page\n")
    assert got[200]["text"] == "" and got[200]["n_chars"] == 0 and got[201]["text"] == "x"
    assert html.extract(pages).count() == 12 and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_copies_of_a_page_are_no_repetition(spark):
    source = "<body><div id='post-7'><div id='a7'><p>The first half of it</p></div><div id='b7'><p>The second half, longer than that</p></div></div></body>"
    inside = "<article><div class='x'><p>%s</p></div><p>Text number %d that is long enough</p></article>"
    data = [(k, "http://h.example/a", source, "", "", "") for k in range(8)]
    # A box that most pages of a host repeat is furniture in an article too; one that fewer repeat stays.
    data += [(100 + k, f"http://g.example/{k}", inside % ("short", k), "", "", "") for k in range(8)]
    data += [(200 + k, f"http://f.example/{k}", inside % ("short" if k < 5 else f"own {k}", k), "", "", "") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in rows(html.extract(spark.createDataFrame(data, PAGES)))}
    assert {got[k] for k in range(8)} == {"The first half of it\nThe second half, longer than that"}
    assert all(got[100 + k] == f"Text number {k} that is long enough" for k in range(8))
    assert all(got[200 + k] == f"{'short' if k < 5 else f'own {k}'}\nText number {k} that is long enough" for k in range(12))


def test_importance_by_hand(spark):
    data = [("h", 1, s, f) for s, f in ((1, 1), (1, 1), (1, 2), (2, 3))] + [("h", 2, 1, 1)] * 4
    got = {r["path"]: r["importance"] for r in rows(html.importance(spark.createDataFrame(data, "host string, path long, style long, feature long")))}
    presentation = -(0.75 * -0.2075187 + 0.25 * -1.0)
    assert abs(got[1] - (0.1 * presentation + 0.9 * (1 - 0.5 / 3))) < 1e-6 and abs(got[2]) < 1e-12


def test_empty_table(spark):
    assert rows(html.extract(spark.createDataFrame([], PAGES))) == []
