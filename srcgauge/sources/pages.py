"""Reading code from saved web pages: URL parts, file name and code text.

The URL is read with built-in expressions. Elements need their own closing tags,
which no pattern finds, so pages are walked in Arrow batches; only pages with one
of the markers in their source are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as SF

from ..functions import sqltext as F
from ..functions.sqltext import Expr
from ..functions.text import language_detect
from . import dom
from .dom import Element, Page, Selector, Tag, has, has_class, under

# What marks a page as a file view.
FILE_PAGE_TESTIDS = ("raw-button", "react-blob", "code-viewer")
FILE_PAGE_CLASSES = (
    "react-blob-print-hide",
    "blob-code",
    "react-code-text",
    "react-code-lines",
    "react-code-line-contents",
)


def url_path(url: Expr) -> Expr:
    """The path of a URL; '/' when it has none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(path == "", "/").otherwise(path)


# Selectors of file names, code lines and whole blocks, in their order.
NAME_SELECTORS = (
    has("data-testid", "breadcrumbs-filename"),
    under(
        has("data-testid", "breadcrumbs"), Selector(lambda t: t.name == "li", lambda e: e.after is None)
    ),
    under(has_class("react-directory-filename-column"), Selector(lambda t: t.name == "a")),
    has_class("final-path"),
    under(has("data-testid", tag="h2"), has_class("Link--primary")),
)


def _after_number(e: Element) -> bool:
    return e.before is not None and "data-line-number" in e.before.kind.attributes


LINE_SELECTORS = (
    under(has_class("react-code-line-contents"), has_class("react-code-text")),
    under(has_class("react-code-line-contents"), has("data-testid", "react-code-text")),
    has_class("react-code-line-contents"),
    has_class("react-file-line"),
    has_class("blob-code", tag="td"),
    has_class("blob-code-inner", tag="td"),
    Selector(lambda t: t.name == "td", _after_number),
    Selector(lambda t: True, _after_number),
    Selector(lambda t: "react-code-line" in t.classes or "blob-code" in t.classes),
)
TEXT_SELECTORS = (
    has_class("react-code-text"),
    has("data-testid", "react-code-text"),
    has_class("react-code-line-contents"),
    has_class("react-file-line"),
    has_class("blob-code-inner"),
)
CODE_TAGS = ("pre", "code", "table")
#: A page without any of these has none of the elements above.
HINTS = ("data-testid", "blob-", "react-", "data-line-number", "final-path", "Link--primary", "highlight")


def _is_mark(t: Tag) -> bool:
    return (
        t.attributes.get("data-testid") in FILE_PAGE_TESTIDS
        or not t.classes.isdisjoint(FILE_PAGE_CLASSES)
        or "data-line-number" in t.attributes
    )


def _marked(page: Page) -> bool:
    return page.first(Selector(_is_mark)) is not None


def _name(page: Page) -> str | None:
    for selector in NAME_SELECTORS:
        found = page.first(selector)
        if found is not None and (text := found.text.strip()):
            return text
    return None


def _line(e: Element) -> str:
    return e.text.replace("\r", "").removesuffix("\n")


def _code(page: Page) -> str | None:
    """Code of a page: line cells first, then whole blocks."""
    lines = next((found for s in LINE_SELECTORS if (found := page.all(s))), [])
    texts = [_line(e) for e in lines]
    if any(texts):
        return "\n".join(texts)
    for selector in TEXT_SELECTORS:
        if found := page.all(selector):
            return "\n".join(e.text for e in found)
    blob = has("data-testid", "react-blob")
    wrapper = page.first(Selector(lambda t: "blob-wrapper" in t.classes or blob.tag(t)))
    if wrapper is not None:
        code = page.first(
            Selector(lambda t: t.name in CODE_TAGS, lambda e: e.inside(lambda x: x is wrapper))
        )
        if code is not None:
            return code.text
    inside = under(has("data-hpc"), has_class("react-code-lines"))
    for selector in (
        has_class("data", "highlight"),
        Selector(lambda t: True, lambda e: inside(e) or "react-blob-print-hide" in e.kind.classes),
    ):
        if (found := page.first(selector)) is not None:
            return found.text
    return None


def _hinted(html: Column) -> Column:
    hinted = SF.lit(False)
    for hint in HINTS:
        hinted = hinted | SF.contains(html, SF.lit(hint))
    return hinted


def _reader(what: Callable[[Page], object], ddl: str) -> Callable[[Column], Column]:
    """A column function of the page source, null for pages without a hint."""

    @SF.pandas_udf(ddl)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [None if source is None else what(dom.read(source)) for source in batch], dtype=object
            )

    return lambda html: read(SF.when(_hinted(html), html))


def _by_path(url: Expr) -> Column:
    by_path = F.regexp_like(url_path(url), F.lit(r"^/[^/]+/[^/]+/blob/")).column
    return SF.coalesce(by_path, SF.lit(False))


def page_is_file(url: Expr, html: Expr) -> Column:
    return _by_path(url) | SF.coalesce(_reader(_marked, "boolean")(html.column), SF.lit(False))


def page_repo_parts(url: Expr) -> Expr:
    """Struct owner, repo; null when the path has fewer than three pieces."""
    parts = F.split(url_path(url), "/", -1)
    return F.when(
        F.size(parts) >= 3,
        F.struct(
            F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("repo")
        ),
    )


def _last_piece(url: Expr) -> Column:
    return F.element_at(F.split(url_path(url), "/", -1), -1).column


def page_file_name(url: Expr, html: Expr) -> Column:
    """First non-blank breadcrumb, else the last piece of the path."""
    return SF.coalesce(_reader(_name, "string")(html.column), _last_piece(url))


def page_code_text(html: Expr) -> Column:
    """Code of a saved page; null if it shows none."""
    return _reader(_code, "string")(html.column)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Is it a file, what is it called, what does it show: answered on one reading."""
    for batch in batches:
        names, codes = [], []
        for by_path, last, source in zip(*(batch.column(k).to_pylist() for k in ("by_path", "last", "html"))):
            page = dom.read(source)
            is_file = by_path or _marked(page)
            codes.append(_code(page) if is_file else None)
            names.append((_name(page) or last) if is_file else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file_id"), pa.array(names, pa.string()), pa.array(codes, pa.string())],
            names=["file_id", "filename", "code"],
        )


def pages_to_files(pages: DataFrame) -> DataFrame:
    """File pages of a supported language as (file_id, filename, code) rows.

    A page is read once. One without a hint shows no code, so it is not sent.
    """
    url = F.col("url")
    sent = pages.filter(_hinted(SF.col("html"))).select(
        SF.col("page_id").alias("file_id"),
        _by_path(url).alias("by_path"),
        _last_piece(url).alias("last"),
        "html",
    )
    id_type = sent.schema["file_id"].dataType.simpleString()
    read = sent.mapInArrow(_read_files, f"file_id {id_type}, filename string, code string")
    return read.filter("code is not null").filter((language_detect(F.col("filename")) != "unknown").column)
