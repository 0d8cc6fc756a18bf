import pyarrow.dataset as ds
import pytest

import __spark_entry__ as entry
from srcgauge.llm.html import extract, host_of, main_text, read_page
from tests.llm.conftest import SMALL
from tests.oracle_check import compare


def page(url, html, n=[0]):  # noqa: B006
    n[0] += 1
    return n[0], url, html, "x", 7


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")


def test_query_equals_its_twin(spark, con, sf_dir):
    name = "op3_host_path_text"
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) == ""


def test_query_leaves_page_furniture(spark):
    found = {r.page_id: r for r in entry.queries()["op3_host_path_text"](spark, SMALL).collect()}
    pages = ds.dataset(f"{SMALL}/pages.parquet").to_table().to_pylist()
    assert len(found) == len(pages)
    for p in pages:
        r = found[p["page_id"]]
        assert r.n_chars == len(r.text) and "©" not in r.text and "track(" not in r.text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a  b\n c<p>d", "a b c\nd"),
        ("<div>x<br>y<b> z</b></div><script>var t='</p>';</script><p>&lt;&amp;amp;&#x41;&nbsp;&eacute;", "x y z\n<&amp;A é"),
        ("<ul><li>one<li>two<ul><li>deep</ul></ul><p>end", "one\ntwo\ndeep\nend"),
        ("<body><nav><p>menu</nav><div class='Side-Bar sidebar'><p>no</div><p>yes</p><form>q</form>", "yes"),
        ("<article><p>kept <!-- <p>not --> text</p></article><div id=comments><p>said</div>", "kept text"),
        ("<p title='a > b'>ok</p><p class=\"x>unclosed", "ok\nunclosed"),
        ("text <b>only", "text only"),
        ("", ""),
        ("<nav>only menus</nav>", ""),
        ("</div></p>stray<p/>", "stray"),
    ],
)
def test_pages(html, text):
    body = html if html.startswith("<body") else f"<body>{html}"
    assert extract(body, []) == text


def test_consensus_of_a_host_beats_a_page(spark):
    """Most pages of a host hold their text in div.post-#; one has a longer div.links."""
    usual = "<body><div class=links><p>see</div><div class='post-{}'><p>{}</p></div></body>"
    rows = [page("http://a.org/x", usual.format(i, "word " * 30)) for i in range(9)]
    rows.append(page("http://A.org:80/y", usual.format(99, "short").replace("see", "see " * 90)))
    rows.append(page("http://b.org/", usual.format(1, "short").replace("see", "see " * 90)))
    texts = [r.text for r in main_text(frame(spark, rows)).orderBy("page_id").collect()]
    assert texts[:9] == [("word " * 30).strip()] * 9
    assert texts[9] == "short"
    assert texts[10].startswith("see see")


def test_join_by_host_gives_the_same(spark):
    rows = [page(f"http://h{i % 7}.org/", f"<body><article><p>t{i}</article>") for i in range(60)]
    df = frame(spark, rows)
    a = sorted(tuple(r) for r in main_text(df).collect())
    assert a == sorted(tuple(r) for r in main_text(df, broadcast_hosts=0).collect())


def test_edge_rows(spark):
    long = "<body>" + "<p>word</p>" * 20_000
    rows = [(1, None, None, "x", 7), (1, None, None, "x", 7), (None, "odd", "<p>a", "x", 7), (3, "http://c.org", long, "x", 7)]
    df = frame(spark, rows)
    got = sorted((r.page_id or 0, r.url or "", r.n_chars) for r in main_text(df).collect())
    assert got == [(0, "odd", 1), (1, "", 0), (1, "", 0), (3, "http://c.org", 99_999)]
    assert main_text(df.limit(0)).count() == 0


def test_deep_and_unclosed_markup_is_fast():
    source = "<body>" + "<div>" * 3000 + "<p>x" + "<a href='" * 3000
    assert read_page(source).blocks[0].startswith("x")


def test_host():
    assert [host_of(u) for u in ("HTTP://u@A.b:1/c", "x", None, "//h/")] == ["a.b", "", "", ""]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<title>x</title><h1>T</h1><p>one<p>two", "T\none\ntwo"),
        ("<title>x</title><h1>T</h1><p>one<div>small</div>", "T\none\nsmall"),
        ("<body><div class='content has-sidebar'><p>the text</p><div class=sidebar>no</div></div><p>tag", "the text\ntag"),
        ("<body><div id='page-with-comments'><p>the text</p><div id=comments><p>said</div></div>", "the text"),
        ("<body><div class='post share-enabled'><p>the text</p></div>", "the text"),
        ("<body><div class=no-sidebar><h1>T</h1><p>text</p></div><div class=sidebar>side</div>", "T\ntext"),
        ("<body><div class=widget><p>a</p></div><div class=widget><p>b</p></div>", "a\nb"),
        ("<body><article><p>short</p></article><div class=comments-area><p>much said here</div>", "short"),
        ("<body><div class=post><p>short</p></div><div id=comments><p>much said here</div>", "short"),
    ],
)
def test_whole_articles_stay(html, text):
    assert extract(html, []) == text


LONG = "word " * 30 + "end"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>T</h1><p>lede</p><div class=body><p>{}</p></div></article>", "T\nlede\n{}"),
        ("<main><article><section class=a><p>one</section><section class=b><p>{}</section></article></main>", "one\n{}"),
        ("<div class=post><h1>T</h1><p>lede</p><p><a href=/>all posts</a></p><div class=body><p>{}</div></div>", "T\nlede\n{}"),
        ("<section class=a><p>one</section><section class=b><p>{}</section>", "one\n{}"),
        ("<div class=links><p>see</div><div class=body><p>{}</div>", "{}"),
    ],
)
def test_what_stands_beside_the_body_stays(spark, html, text):
    rows = [page("http://a.org/", "<body>" + html.format(LONG)) for _ in range(3)]
    found = main_text(frame(spark, rows)).collect()
    assert [r.text for r in found] == [text.format(LONG)] * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<form id=aspnet><div><h1>Hi</h1><p>one</p><p>two<input></p><select><option>x</select></div></form>", "Hi\none\ntwo"),
        ("<form><article><h1>Hi</h1><p>one</p></article><div class=sidebar>side</div></form>", "Hi\none"),
        ("<form><div><p>no heading, only text</p></div></form>", "no heading, only text"),
        ("<article><h1>Hi</h1><p>one</p><form><p>write to us<input></form></article>", "Hi\none"),
        ("<h1>Hi</h1><p>one</p><form><p>a form of more words than the text has</p></form>", "Hi\none"),
        ("<nav>menu</nav><form><label>find</label><input></form>", ""),
        ("<article><header><h1>Title</h1><p>By me</p></header><p>text</p></article>", "Title\nBy me\ntext"),
        ("<article><div class=entry-header><h1>Title</h1></div><p>text</p></article>", "Title\ntext"),
        ("<header><h1>Site</h1></header><article><p>text</p></article><footer>end</footer>", "text"),
        ("<article class=a><p>first text</p></article><article class=b><p>second</p></article>", "first text\nsecond"),
        ("<article class=a><p>first text</p></article><article class=teaser><a href=/>more of it</a></article>", "first text"),
        ("<div><p><a href=/a>one</a></p><p><a href=/b>two</a></p></div>", "one\ntwo"),
        ("<article><p>text</p><p class=share-price>It costs 12.</p></article>", "text\nIt costs 12."),
        ("<article><p>text</p><section id=related-work><h2>Work</h2><p>of others</p></section></article>", "text\nWork\nof others"),
        ("<article><p>text</p><div class=related-posts><a href=/>another one</a></div></article>", "text"),
        ("<article><p>text</p><div class=share-bar>Share <a href=/>Facebook</a> <a href=/>by mail</a></div></article>", "text"),
        ("<article><p>text</p><div class=replies><p>said</p></div></article>", "text"),
        ("<div class=post><p>the text</p></div><div class=discussion><p>said</p></div>", "the text"),
        ("<article><p>text</p><article class='comment depth-1'><p>said</p></article></article>", "text"),
        ("<article><p>text</p><div class=adslot>buy</div><div class=outbrain>buy</div></article>", "text"),
        ("<article><p>text</p><p hidden>no</p><div style='display: none'>no</div><p data-hidden=x>yes</p></article>", "text\nyes"),
        ("<div style='visibility:hidden'><h1>T</h1><p>shown by a script</p></div>", "T\nshown by a script"),
        ("<article><p title='a hidden thing'>text</p></article>", "text"),
    ],
)
def test_layouts(html, text):
    assert extract("<body>" + html, []) == text


@pytest.mark.parametrize(
    "html",
    [
        "<article><header><h1>T{0}</h1></header><div class=body><p>one {0}</p><div class=box><p>two</p></div></div></article>",
        "<main><section class=a><h1>T{0}</h1><p>one {0}</p></section><section class=b><p>two</p></section></main>",
        "<form><div class=page><h1>T{0}</h1><p>one {0}</p><table><tr><td>two</table></div></form>",
    ],
)
def test_containers_inside_articles_of_a_host(spark, html):
    around = "<body><nav>menu</nav>{}<footer>end</footer></body>"
    rows = [page("http://a.org/", around.format(html.format(i))) for i in range(5)]
    found = main_text(frame(spark, rows)).orderBy("page_id").collect()
    assert [r.text for r in found] == [f"T{i}\none {i}\ntwo" for i in range(5)]
