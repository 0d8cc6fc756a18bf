"""Reading code and names from saved pages."""

import pytest

from srcgauge.functions import sqltext as E
from srcgauge.sources import dom, pages

BLOB = "https://code.example.com/me/tool/blob/main/src/app.js"


def one(spark, expression, url=BLOB, html=""):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    return df.select(expression.column if isinstance(expression, E.Expr) else expression).first()[0]


URL, HTML = E.col("url"), E.col("html")

LAYOUTS = {
    "nested": '<div class="react-code-text num">1</div><div class="react-code-line-contents">'
    '<div class="x react-code-text">if (<b>a</b> &lt; 1) {</div></div>'
    '<div class="react-code-line-contents"><div class="react-code-text">}</div></div>',
    "testid": '<p class="react-code-line-contents"><i data-testid="react-code-text">if (a &lt; 1) {</i></p>'
    '<p class="react-code-line-contents"><i data-testid="react-code-text">}</i></p>',
    "contents": '<p class="react-code-line-contents">if (a &lt; 1) {</p><p class="react-code-line-contents">}\n</p>',
    "file_line": '<p class="react-file-line">if (a &lt; 1) {</p><p class="react-file-line x">}</p>',
    "cells": '<td class="blob-num" data-line-number="1"></td><td class="blob-code">if (a &lt; 1) {\r\n</td>'
    '<td class="blob-num" data-line-number="2"></td><td class="blob-code">}</td>',
    "numbered": '<td data-line-number="1"></td><td>if (a &lt; 1) {</td><td data-line-number="2"></td> <td>}</td>',
    "siblings": '<i data-line-number="1">1</i><pre>if (a &lt; 1) {</pre><i data-line-number="2"></i><pre>}</pre>',
    "any": '<p class="react-code-line">if (a &lt; 1) {</p><p class="blob-code">}</p>',
    "texts": '<p class="react-code-text">if (a &lt; 1) {</p><p class="react-code-text">}</p>',
    "wrapper": '<div class="blob-wrapper"><pre>if (a &lt; 1) {\n}</pre></div>',
    "blob": '<section data-testid="react-blob"><code>if (a &lt; 1) {\n}</code></section>',
    "raw": '<div class="data highlight">if (a &lt; 1) {\n}</div>',
    "nested blocks": '<div class="react-blob-print-hide"><div>if (a &lt; 1) {</div>\n<div>}</div></div>',
    "inner tags": '<div class="react-code-line-contents"><div class="react-code-text">if (<div>a</div> &lt; 1) {'
    '</div></div><div class="react-code-line-contents"><p class="react-code-text">}</p></div>',
    "all lines": "<main data-hpc><div class='react-code-lines'><div>if (a &#60; 1) {\n</div><div>}</div></div></main>",
    "single quotes": "<p class='react-file-line'>if (a &lt; 1) {</p><p class='react-file-line x'>&#x7d;</p>",
    "print": '<div class="react-blob-print-hide">if (a &lt; 1) {\n}</div>',
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_code_text(spark, layout):
    assert one(spark, pages.page_code_text(HTML), html=LAYOUTS[layout]) == "if (a < 1) {\n}"


def test_a_condition_around_an_element(spark):
    alone = "<div class=react-code-lines><p>a</p></div>"
    assert one(spark, pages.page_code_text(HTML), html=alone) is None


def test_no_code(spark):
    assert one(spark, pages.page_code_text(HTML), html="<p>blob-code</p>") is None


@pytest.mark.parametrize(
    ("url", "html", "want"),
    [
        (BLOB, "", True),
        ("https://code.example.com/me/tool/tree/main", "", False),
        ("https://x.example/a", '<a href="#" data-testid="raw-button">', True),
        ("https://x.example/a", '<td class="a blob-code b">', True),
        ("https://x.example/a", '<td class="blob-coder">', False),
        ("https://x.example/a", '<td id="l" data-line-number="4">', True),
        ("https://x.example/a", "<p>data-line-number</p>", False),
    ],
)
def test_is_file(spark, url, html, want):
    assert one(spark, pages.page_is_file(URL, HTML), url, html) is want


def test_repo_parts(spark):
    assert tuple(one(spark, pages.page_repo_parts(URL))) == ("me", "tool")
    assert one(spark, pages.page_repo_parts(URL), "https://x.example/a?b=/c/d") is None
    assert one(spark, pages.page_repo_parts(URL), "https://x.example") is None


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", "app.js"),
        ('<b data-testid="breadcrumbs-filename"> a.py </b>', "a.py"),
        ('<b data-testid="breadcrumbs-filename"> </b>', "app.js"),
        ('<ul data-testid="breadcrumbs"><li>src</li><li>b.ts</li></ul>', "b.ts"),
        ('<div class="react-directory-filename-column"><a href="x">c.js</a></div>', "c.js"),
        ('<p class="react-directory-filename-column">x</p>'
         "<p class='react-directory-filename-column'><a>&#x63;&#46;js</a></p>", "c.js"),
        ('<strong class="final-path">d.py</strong>', "d.py"),
        ('<h2 data-testid="t"><a class="Link--primary">e.py</a></h2>', "e.py"),
    ],
)
def test_file_name(spark, html, want):
    assert one(spark, pages.page_file_name(URL, HTML), html=html) == want


def test_files_are_read_from_pages_once(spark):
    rows = [
        (1, BLOB, LAYOUTS["cells"]),
        (2, "https://x.example/a/b.py", LAYOUTS["raw"]),  # shows code, but nothing says file
        (3, "https://x.example/a/b.py", LAYOUTS["print"]),
        (4, BLOB.replace(".js", ".md"), LAYOUTS["cells"]),
        (5, BLOB, '<b data-testid="breadcrumbs-filename"> a.py </b>'),  # shows no code
        (6, None, LAYOUTS["cells"]),
        (7, BLOB, None),
        (8, BLOB, "<p>a page</p>"),
        (9, None, '<i class="final-path">d.py</i>' + LAYOUTS["numbered"]),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    files = pages.pages_to_files(df)
    code = "if (a < 1) {\n}"
    assert sorted(map(tuple, files.collect())) == [(1, "app.js", code), (3, "b.py", code), (9, "d.py", code)]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_tags_of_one_source_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(dom, "_known", {})
    monkeypatch.setattr(dom, "_tag", lambda found, real=dom._tag: parsed.append(found[0]) or real(found))
    page = dom.read('<ul class="a"><li>1<li>2</ul><!-- x --><!-- x --><ul class="a"><li>3</ul>')
    assert sorted(parsed) == sorted(['<ul class="a">', "<li>", "</ul>", "<!-- x -->"])
    assert [e.text for e in page.all(dom.has_class("a"))] == ["12", "3"]
    assert [e.after is None for e in page.elements] == [False, False, True, True, True]


def test_remembered_tags_are_bounded(monkeypatch):
    monkeypatch.setattr(dom, "_known", {})
    monkeypatch.setattr(dom, "KNOWN_TAGS", 10)
    many = "".join(f"<td data-line-number={i}>{i}" for i in range(50)) + f"<p title='{'x' * 300}'>y</p>"
    page = dom.read(many)
    assert len(page.elements) == 51 and len(dom._known) <= 10
    assert all(len(source) <= dom.KNOWN_LENGTH for source in dom._known)
