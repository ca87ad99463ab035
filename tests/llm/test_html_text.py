import time

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html_text as H


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;\n here", "plain <text> here"),
        ("<p>One <b>two</b>three<br>four<p>five", "One twothree four five"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no</p> --></p>", "yes"),
        ("<nav>menu</nav><article><h1>T</h1><p>x&amp;amp;y</p></article><footer>f</footer>", "T x&amp;y"),
        ("<header>site</header><article><header><h1>T</h1><p>by me</p></header><p>x</p></article>", "T x"),
        ("<form><main><p>kept</p><form>no</form></main></form>", "kept"),
        ("<div class='cookie-banner'>no</div><div class='no-sidebar'>yes</div><div id=sideBar>no</div>", "yes"),
        ("<article><p>a</p><section class='reader-comments'><p>no</p></section><span class=ad>no</span>b</article>", "a b"),
        ("</p></div><p>a</i></b>b", "ab"),
        ("<p title='a>b'>x</p><img alt=\"<p>\">", "x"),
        ("<p>a < b & c</p>", "a < b & c"),
        ("<script>never closed <p>no", ""),
        ("<b>" * 3000 + "deep", "deep"),
        ("<div hidden>no</div><div style='display: none'>no</div><div role=navigation>no</div>yes", "yes"),
    ],
)
def test_page_text(source, want):
    assert H.page_text(source) == want


def pages():
    promo = "<div><p>Read our <i>new</i> book</p></div>"
    rows = [(i, f"http://a.org:80/{i}", f"<body><p>story {i}</p>{promo}</body>") for i in range(9)]
    rows += [(100 + i, f"https://b.org/{i}", f"<body><p>tale {i}</p>{promo}</body>") for i in range(4)]
    return [*rows, (200, None, "<p>lone"), (None, "http://a.org/x", None), (201, "bad", "")]


@pytest.mark.parametrize("bound", [H.BROADCAST_ROWS, 0])
def test_templates_go_where_they_recur(spark, bound):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    out = H.main_text(df, broadcast_rows=bound)
    got = {r.page_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_templates"]
    assert got[3] == ("story 3", 7)
    assert got[101] == ("tale 1 Read our new book", 24)
    assert got[200] == ("lone", 4) and got[None] == ("", 0) and got[201] == ("", 0)
    assert len(got) == 16


def test_empty_table(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_counts_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    hashes = H.subtree_hashes(rows)
    for least, articles, many in ((H.MIN_PAGES, H.MIN_ARTICLES, H.MANY), (2, 1, 3)):
        got = {(r.host, r.hash) for r in H.recurring_subtrees(hashes, least, articles, many).collect()}
        seen, hosts = {}, {}
        for r in rows.collect():
            host, page = H.host_of(r.url), H.Page(r.html)
            hosts[host] = hosts.get(host, 0) + 1
            for kind, h in page.subtrees():
                seen.setdefault((host, kind, h), []).append(page.article())
        share = {1: H.SHARE, 2: H.BLOCK_SHARE, 3: H.SHAPE_SHARE}
        often = lambda host, kind, n: n >= share[kind] * hosts[host] or (kind == 1 and n >= many)
        want = {(host, h) for (host, kind, h), a in seen.items() if len(a) >= least and len(set(a)) >= articles and often(host, kind, len(a))}
        assert got == want


STORY = "<div class='s{0}'><p>Story number {0} tells of a river and of the town beside it.</p><p>It goes on with part {0} for a while.</p></div>"


def plain_site(n):
    """Furniture without a telling tag or name: a menu whose entries differ, a box that rotates, a closing line; a third of the pages is one article."""
    rows = []
    for i in range(n):
        menu = "".join(f"<li><a href='/{i}/{k}'>place {i * k}</a>" for k in range(1, 4 + i % 3))
        box = f"<div class='z9'><p>Offer {i % 4}: buy now and save.</p></div>"
        body = STORY.format(7) if i % 3 == 0 else STORY.format(i)
        rows.append((i, f"http://plain.org/{i}", f"<body><div class='x1'><ul>{menu}</ul></div>{body}{box}<div>All rights with Plain Org.</div></body>"))
    return rows


@pytest.mark.parametrize("names", [True, False])
def test_furniture_without_telling_names_goes_by_counting(spark, names):
    rows = plain_site(60)
    out = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), names=names).collect()}
    for i in range(60):
        k = 7 if i % 3 == 0 else i
        assert out[i].text == f"Story number {k} tells of a river and of the town beside it. It goes on with part {k} for a while."
        assert out[i].n_templates >= 3
    few = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows[:4], "page_id long, url string, html string"), names=names).collect()}
    assert few[1].n_templates == 0 and "Plain Org" in few[1].text


def test_menus_of_the_documents_recur_in_structure(spark):
    """Their entries differ from page to page, so as they are they hardly recur."""
    out = H.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), names=False)
    assert out.where("n_templates > 0").count() > 0.4 * out.count()


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p title=it's>kept one</p><p>two it's</p>", "kept one two it's"),
        ('<p data-x="a>one</p><p>two</p>', "one two"),
        ("<div class='share-price'>a</div><div class='ad-free-content'>b</div><div class='notice-of-sale'>c</div>", "a b c"),
        ("<div class='share-buttons'>a</div><div class='site-footer'>b</div><div class='cookieBanner'>c</div><div class='ad-box-2'>d</div>e", "e"),
        ("<p>a<a href='x", "a"),
    ],
)
def test_quotes_and_names_that_only_look_like_furniture(source, want):
    assert H.page_text(source) == want


@pytest.mark.parametrize("piece", ['<a "', "<b>", "<p a='", "<li>", "<div class='", "<", "<b></i>", "<b><li>x", "<div><p>"])
def test_time_is_linear(piece):
    def seconds(n):
        began = time.process_time()
        H.page_text(piece * n)
        return time.process_time() - began

    assert seconds(40_000) < 5


def test_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.org", "<p>x")] * 3, "page_id long, url string, html string")
    for name in ("host", "hash", "text", "marks", "n_chars", "article"):
        df = df.withColumn(name, F.lit("y"))
    assert [(r.text, r.n_chars) for r in H.main_text(df).collect()] == [("x", 1)] * 3


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><p>a</p><section class='comments'><article class='comment'><p>no</p></article></section></article>", "a"),
        ("<main><p>a</p></main><aside class='related'><article><p>no</p></article></aside>", "a"),
        ("<article><p>a</p><article class='comment'><p>no</p></article><article><p>b</p></article></article>", "a b"),
        ("<aside><article><p>short</p></article></aside><form><article><p>the story itself</p></article></form>", "the story itself"),
        ("<main><h1>T</h1><form><article><p>story</p></article></form></main>", "story"),
    ],
)
def test_nested_articles_do_not_clear_what_drops_them(source, want):
    assert H.page_text(source) == want
