"""Main text of web pages by consensus paths of each host.

1. Every page's containers are scored by the text of their blocks, and the path of
   the best one (tags and classes from the root, digits generalised) is the page's
   vote.
2. Votes are counted per host in Spark; paths with a good share of them win.
3. Every page is read again: its text is that of the containers on its host's
   best winning path that the page has, or of its own best container if it has none,
   and of the article around them.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and the like
are left out by their tags, roles and class words in both passes; a class word, or a
form around the page, does not count where it would leave out the page's text itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgauge.llm.common import slices, small_batches, stored

#: A path wins with this share of its host's votes.
WINNING_SHARE = 0.1
#: What a container passes on to the one around it.
PASSED_ON = 0.7
#: Hosts whose winners are broadcast at most; beyond it pages are joined by host.
BROADCAST_HOSTS = 100_000
#: Parts into which a host's pages are dealt when they are joined.
SALTS = 32
STEP_BYTES = 4 << 20

# Fixed values of HTML: tags without content, tags whose content is not markup, and
# tags that begin a block.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style title textarea noscript iframe xmp noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend"
    " li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
#: Blocks that can hold an article; other blocks are its paragraphs.
CONTAINER = frozenset("body article main section div td center table".split())
#: A start tag on the left ends an open tag on the right.
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"},
}
#: Open tags beyond which a start tag ends nothing.
SCOPE = frozenset("ul ol dl table td th div section article main body aside".split())
BOILERPLATE_TAGS = frozenset(
    "head nav header footer aside menu dialog button label select svg object audio video canvas"
    .split()
)
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu"
    " menubar toolbar".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads adsbygoogle adsense adslot adunit advert adverts advertisement advertising banner"
    " breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead"
    " menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup"
    " promo promoted promotion related replies reply respond discussion share sharing sidebar"
    " signup social sponsor sponsored subscribe taboola toolbar widget".split()
)
#: Of these, words that an article's own parts are named with too: there, as a part of a
#: name, they count only where most of the text is links.
EVERYDAY_WORDS = frozenset(
    "banner discussion header notice notices promotion related reply respond share sharing social"
    .split()
)
#: An article element of such a class or id is a reader's comment.
COMMENT_WORDS = frozenset("comment comments replies reply".split())
#: Elements that text is written in, other than containers.
WRITTEN = frozenset("h1 h2 h3 p article blockquote".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    path: str
    parent: Node | None
    skipped: bool
    #: Left out by its tag or role, or inside such an element.
    hard: bool = False
    #: The outermost article or main element around it, itself included.
    article: Node | None = None
    #: Letters inside that no tag or role leaves out; whether a main heading is there.
    letters: int = 0
    headed: bool = False
    #: Of the letters those in links; whether a heading or paragraph is there.
    linked: int = 0
    written: bool = False
    container: Node | None = None
    link: bool = False
    #: A container's outer one.
    outer: Node | None = None
    score: float = 0.0
    #: Numbers of the blocks inside: first, after the last.
    first: int = 0
    last: int = 0


@dataclass
class Page:
    """Containers and kept blocks of a page, the first container being an implicit body."""

    containers: list[Node] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    #: Per block its container, and whether most of it is no link.
    holders: list[Node] = field(default_factory=list)
    plain: list[bool] = field(default_factory=list)
    #: Elements left out by a class word, or as forms: (element, how much that says).
    doubted: list[tuple[Node, int]] = field(default_factory=list)
    #: Kept letters inside article or main elements.
    in_articles: int = 0

    def best(self) -> Node | None:
        """The container of highest score, the first in page order among equals."""
        found = max(self.containers, key=lambda c: c.score, default=None)
        return found if found is not None and found.score > 0 else None

    def text(self, nodes: list[Node]) -> str:
        """The text of containers: of the outermost article or main element around each
        and the articles beside it; without one also what the containers around it hold
        themselves and is no link, and the sections beside a section."""
        keep = bytearray(len(self.blocks))
        around: set[Node] = set()
        of_sections: set[Node] = set()
        for top in dict.fromkeys(n.article or n for n in nodes):
            keep[top.first : top.last] = b"\1" * (top.last - top.first)
            inner, outer = top, None if top.article else top.outer
            while outer is not None and (outer not in around or inner.tag == "section"):
                around.add(outer)
                if inner.tag == "section":
                    of_sections.add(outer)
                inner, outer = outer, outer.outer
        tops = dict.fromkeys(n.article for n in nodes if n.article is not None)
        beside = {t.outer for t in tops if t.tag == "article"}
        for c in self.containers if beside else []:
            if c.tag == "article" and c.outer in beside and 2 * c.linked <= c.letters:
                keep[c.first : c.last] = b"\1" * (c.last - c.first)
        sections: set[Node] = set()
        for c in self.containers if of_sections else []:
            if c.outer in sections or c.tag == "section" and c.outer in of_sections:
                sections.add(c)
        for i, holder in enumerate(self.holders if around else []):
            if self.plain[i] and (holder in around or holder in sections):
                keep[i] = 1
        return "\n".join(b for b, kept in zip(self.blocks, keep, strict=True) if kept)

    def excused(self) -> set[str]:
        """Paths of the elements that a class word leaves out although they hold the text.

        They hold most of the page's letters, and: with the word in a part of the name, no
        article is elsewhere; with the word as a name, the main heading is there too; for a
        form, the main heading, or what is written if neither is elsewhere. Or they are in an
        article, an everyday word is a part of their name and at most half are links."""
        root = self.containers[0]
        out = set()
        for n, doubt in self.doubted:
            alone = n.article is not None or not self.in_articles
            most = n.letters > root.letters / 2
            if doubt == EVERYDAY:
                good = 2 * n.linked <= n.letters
            elif doubt == PART:
                good = most and alone
            else:
                plain = doubt == FORM and n.written and not root.headed and not self.in_articles
                good = most and (n.headed or plain)
            if good:
                out.add(n.path)
        return out

    def on_path(self, path: str) -> list[Node]:
        return [c for c in self.containers if c.path == path]


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _by_tag(tag: str, attributes: dict[str, str], article: Node | None) -> bool:
    if tag == "header" and article is not None:
        return False  # an article's title
    return tag in BOILERPLATE_TAGS or attributes.get("role", "").lower() in BOILERPLATE_ROLES


#: Why an element is doubted: an everyday word inside an article, a listed word as a
#: part of a class or id, as the whole of it (or an element that is not shown), a form.
EVERYDAY, PART, WHOLE, FORM = 1, 2, 3, 4


def _by_word(tag: str, attributes: dict[str, str], article: Node | None) -> int:
    """How a listed word says that an element is no part of the text, 0 if none does."""
    if tag in ("html", "body", "main") or not attributes:
        return 0
    found = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = WORDS.findall(name)
        if tag == "article":
            found = max(found, 0 if COMMENT_WORDS.isdisjoint(words) else WHOLE)
            continue
        listed = [w for w in words if w in BOILERPLATE_WORDS]
        if article is not None and "header" in listed:
            listed.remove("header")
        if not listed:
            continue
        if len(listed) == len(words):
            return WHOLE
        everyday = article is not None and EVERYDAY_WORDS.issuperset(listed)
        found = max(found, EVERYDAY if everyday else PART)
    return found


def _doubt(tag: str, rest: str, attributes: dict[str, str], article: Node | None, by_words: bool) -> int:
    if tag == "form" or attributes.get("role", "").lower() == "form":
        return FORM
    if not by_words or not rest or tag in ("html", "body"):
        return 0
    lower = rest.lower()
    if "hidden" in lower and HIDDEN.search(QUOTED.sub("", rest)):
        return WHOLE
    if "style" in attributes and UNSEEN.search(attributes["style"]):
        return WHOLE
    return _by_word(tag, attributes, article)


def read_page(source: str, winners: list[str] | tuple[str, ...] = ()) -> Page:
    """The page, read again where a class word left out the text itself.

    An element on the way to one of ``winners`` is not left out for a class word.
    """
    page = _walk(source, winners, frozenset(), True)
    if page.doubted and (excused := page.excused()):
        page = _walk(source, winners, excused, True)
    if page.doubted and not page.blocks:
        page = _walk(source, winners, frozenset(), False)
    return page


def _walk(source: str, winners, excused: set[str] | frozenset[str], by_words: bool) -> Page:
    """Walk a page's tags once, tolerating missing and stray end tags."""
    page = Page()
    root = node = Node("", "", None, False)
    root.container = root
    page.containers.append(root)
    words: list[str] = []  # the open block's text, piece by piece
    plain = linked = 0
    holder = root

    def close_block() -> None:
        nonlocal plain, linked
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                page.blocks.append(text)
                page.holders.append(holder)
                page.plain.append(plain >= linked)
                holder.score += len(text) * plain / max(1, plain + linked)
        plain = linked = 0

    def leave(top: Node) -> Node:
        if top.container is top:
            top.last = len(page.blocks)
            top.outer.score += PASSED_ON * top.score
        top.parent.letters += top.letters
        top.parent.linked += top.linked
        top.parent.headed |= top.headed
        top.parent.written |= top.written
        return top.parent

    at, end = 0, len(source)
    while at < end:
        found = TOKEN.search(source, at)
        stop = found.start() if found else end
        if stop > at and not node.hard:
            letters = sum(map(len, source[at:stop].split()))
            node.letters += letters
            if node.link:
                node.linked += letters
            if node.article is not None and not node.skipped:
                page.in_articles += letters
        if stop > at and not node.skipped:
            text = source[at:stop]
            if "&" in text:
                text = html.unescape(text)
            if holder is not node.container:
                holder = node.container
            words.append(text)
            if node.link:
                linked += len(text)
            else:
                plain += len(text)
        if not found:
            break
        at = found.end()
        tag = found.group(2) or found.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1) or found.group(4):
            if tag in BLOCK:
                close_block()
            top = node
            while top.parent is not None and top.tag != tag:
                top = top.parent
            if top.parent is not None:
                while node is not top:
                    node = leave(node)
                node = leave(node)
            continue
        if tag == "br":
            words.append(" ")
            continue
        block = tag in BLOCK
        if block:
            close_block()
            ending = ENDS.get(tag, {"p"})
            top = node
            while top.parent is not None and top.tag not in ending and (
                top.tag not in SCOPE or top.tag == tag
            ):
                top = top.parent
            while top.parent is not None and top.tag in ending:
                while node is not top:
                    node = leave(node)
                node = top = leave(node)
        if tag in VOID:
            continue
        if tag in RAW:
            raw_end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = raw_end.end() if raw_end else end
            continue
        rest = found.group(3) or found.group(6) or ""
        attributes = (
            {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest else {}
        )
        hard = node.hard or _by_tag(tag, attributes, node.article)
        word = 0 if hard else _doubt(tag, rest, attributes, node.article, by_words)
        path = node.path
        if block or word:
            classes = sorted({DIGITS.sub("#", c) for c in attributes.get("class", "").split()})
            path = f"{path}>{'.'.join([tag, *classes])}"
            if word:  # an id may hold the word
                path += "".join(f"#{DIGITS.sub('#', i)}" for i in attributes.get("id", "").split())
        if word and (path in excused or any(f"{w}>".startswith(f"{path}>") for w in winners)):
            word = 0
        node = Node(
            tag, path, node, node.skipped or hard or word > 0, hard, node.article,
            container=node.container, link=node.link or tag == "a",
        )
        node.headed = tag == "h1" and not hard
        node.written = tag in WRITTEN and not hard
        if word:
            page.doubted.append((node, word))
        if tag in CONTAINER and not node.skipped:
            node.outer = node.container
            node.container = node
            node.first = len(page.blocks)
            page.containers.append(node)
            holder = node
        if node.article is None and tag in ("article", "main") and not word:
            node.article = node
    close_block()
    while node.parent is not None:
        node = leave(node)
    root.last = len(page.blocks)
    return page


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, pages that vote for it) of a split."""
    counts: Counter[tuple[str, str]] = Counter()

    def counted() -> pa.RecordBatch:
        rows = sorted(counts.items())
        counts.clear()
        return pa.RecordBatch.from_pydict(
            {
                "host": pa.array([h for (h, _), _ in rows], pa.string()),
                "path": pa.array([p for (_, p), _ in rows], pa.string()),
                "votes": pa.array([n for _, n in rows], pa.int64()),
            }
        )

    for batch in slices(batches, "html", STEP_BYTES):
        for url, source in zip(
            batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True
        ):
            best = read_page(source or "").best()
            if best is not None:
                counts[host_of(url), best.path] += 1
        if len(counts) > 100_000:
            yield counted()
    yield counted()


def extract(source: str, winners: list[str]) -> str:
    """The text of a page, given its host's winning paths, best first."""
    page = read_page(source, winners)
    for path in winners:
        nodes = page.on_path(path)
        text = page.text(nodes) if nodes else ""
        if text:
            return text
    best = page.best()
    # Without a best container all that is kept is links: then these are the text.
    return page.text([best]) if best is not None else "\n".join(page.blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", STEP_BYTES):
        texts = [
            extract(source or "", winners or [])
            for source, winners in zip(
                batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True
            )
        ]
        yield pa.RecordBatch.from_pydict(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def winning_paths(pages: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """Per host its winning paths, most votes first (equal votes: by path)."""
    votes = (
        pages.select("url", "html")
        .mapInArrow(_votes, "host string, path string, votes long")
        .groupBy("host", "path")
        .agg(F.sum("votes").alias("votes"))
    )
    all_ = Window.partitionBy("host")
    # At most 1 / share paths are left to a host.
    won = votes.withColumn("all", F.sum("votes").over(all_)).filter(F.col("votes") >= share * F.col("all"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))
    return won.groupBy("host").agg(order.alias("paths")).select("host", F.col("paths.path").alias("winners"))


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by line breaks) and n_chars.

    Character references are decoded, white space inside a block becomes one space,
    empty blocks go. A null or empty html, or a page without kept text, gives ''. A
    null or odd url counts as the host ''. Repeated rows vote, and appear, as often as
    they occur; an empty table gives no rows; other columns are ignored.

    The winners (a few short paths per host) are written once and broadcast if
    there are at most ``broadcast_hosts``; otherwise pages are joined to them by
    host, each host's pages dealt to ``SALTS`` parts.
    """
    rows = small_batches(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )
    winners = stored(winning_paths(rows), "winners")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), f"(?i){HOST.pattern}", 1))
    rows = rows.withColumn("host", host)
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt.cast("int")).join(dealt, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "winners").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
