"""Near-duplicate functions inside one file, as families.

Two functions are duplicates when the Jaccard similarity of their word sets is
above 4/5. Equal sets are one class. A class's words are its *core*, the words
that other classes of the file hold too, and its private words, which only count:
classes of one core share exactly that core, so whether they are duplicates, and
how alike they are, follows from their sizes alone. All classes of one core and
one number of private words (copies under different names, say) are one *cell* if
they are duplicates of one another. What is found are links between cells, and for
each function how many duplicates come after it; no pair is made for that.

Different cores are compared only if they share a rare word: two sets above the bound
share one of the first words of any common word order, at most ``n - floor(8n/9)`` of
the smaller set and ``n - floor(4n/5)`` of the larger. The order is by rarity in the file
(number of classes that hold the word, then the word). What meets there must also be
near enough in size, and in a 128-bit parity of its words, whose differing bits never
exceed the differing words. All of this is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from . import sqltext as F
from .sqltext import Expr
from . import fixed
from .arrays import empty, group_runs, let, running_sums

PAIR_DDL = "struct<i:int,j:int,line:int,first:string,second:string,percent:int>"
_MEMBERS = "array<struct<ord:int,loc:int,line:int,name:string,sid:int>>"
CLASS_DDL = f"struct<sid:int,words:array<string>,members:{_MEMBERS}>"
CELL_DDL = f"struct<members:{_MEMBERS},links:array<struct<cell:int,percent:int>>>"
HEAD_DDL = "struct<ord:int,cell:int,line:int,name:string,sid:int,later:bigint,start:bigint>"
#: What is found of a file's duplicates: its cells, and its functions that have later
#: duplicates, in order, each with the place of its first pair in the file's pair list.
FOUND_DDL = f"struct<cells:array<{CELL_DDL}>,heads:array<{HEAD_DDL}>>"
#: Words of the parity, of 64 bits each.
LANES = 2
#: Functions of a file up to which its word sets are compared pair by pair first, which
#: tells most such files from those with a duplicate.
FEW = 8


def word_classes(fns: Expr) -> Expr:
    """Functions grouped by equal word set: struct(sid, words, members). None, where no
    function is long enough to be the first of a pair or few functions have no pair."""
    keyed = F.sort_array(
        F.transform(
            fns,
            lambda f: F.struct(
                f["words"].alias("words"),
                f["ord"].alias("ord"),
                f["loc"].alias("loc"),
                f["startLine"].alias("line"),
                f["name"].alias("name"),
            ),
        )
    )
    groups = group_runs(keyed, lambda a, b: a["words"] == b["words"])
    classes = F.transform(
        groups,
        lambda g, i: F.struct(
            i.alias("sid"),
            F.get(g, F.lit(0))["words"].alias("words"),
            F.transform(
                g,
                lambda m: F.struct(
                    *(m[k].alias(k) for k in ("ord", "loc", "line", "name")), i.alias("sid")
                ),
            ).alias("members"),
        ),
    )
    possible = (F.size(fns) > 1) & F.exists(fns, lambda f: f["loc"] > fixed.DUPLICATE_MIN_LOC)
    possible = possible & ((F.size(fns) > FEW) | any_pair(fns))
    return F.when(possible, classes).otherwise(empty(CLASS_DDL))


def any_pair(fns: Expr) -> Expr:
    """Whether any two of some functions have near enough word sets; sizes come first."""

    def near(a: Expr, b: Expr) -> Expr:
        n1, n2 = F.size(a), F.size(b)
        sizes = (n1 * 5 > n2 * 4) & (n2 * 5 > n1 * 4)
        return sizes & close_enough(F.size(F.array_intersect(a, b)), n1, n2)

    return F.exists(
        F.sequence(F.lit(0), F.size(fns) - 1),
        lambda i: let(
            F.get(fns, i)["words"],
            lambda a: F.exists(F.slice(fns, i + 2, F.size(fns)), lambda g: near(a, g["words"])),
        ),
    )


def close_enough(shared: Expr, n1: Expr, n2: Expr) -> Expr:
    """Jaccard > 4/5 in whole numbers."""
    return shared * 5 > (n1 + n2 - shared) * 4


def percent_of(shared: Expr, n1: Expr, n2: Expr) -> Expr:
    return F.floor(shared / (n1 + n2 - shared) * 100 + F.lit(0.5)).cast("int")


def _part(size: Expr, over: int, under: int) -> Expr:
    """floor(size * over / under)."""
    return F.floor(size * over / F.lit(under)).cast("int")


def _cores(classes: Expr) -> Expr:
    """struct(key, p, sid, core) of every class, in order: the core by rarity, and as one text."""
    entries = F.flatten(
        F.transform(
            classes,
            lambda c: F.transform(
                c["words"], lambda w: F.struct(w.alias("word"), c["sid"].alias("sid"))
            ),
        )
    )
    by_word = group_runs(F.sort_array(entries), lambda a, b: a["word"] == b["word"])
    counted = F.flatten(
        F.transform(
            by_word,
            lambda g: F.transform(
                g,
                lambda e: F.struct(
                    e["sid"].alias("sid"), F.size(g).alias("held"), e["word"].alias("word")
                ),
            ),
        )
    )
    rare_first = group_runs(F.sort_array(counted), lambda a, b: a["sid"] == b["sid"])

    def cut(g: Expr, private: Expr) -> Expr:
        core = F.transform(F.slice(g, private + 1, F.size(g)), lambda e: e["word"])
        return let(
            core,
            lambda words: F.struct(
                F.array_join(words, " ").alias("key"),
                private.alias("p"),
                F.get(g, F.lit(0))["sid"].alias("sid"),
                words.alias("core"),
            ),
        )

    return F.sort_array(
        F.transform(
            rare_first,
            lambda g: let(F.size(F.filter(g, lambda e: e["held"] == 1)), lambda p: cut(g, p)),
        )
    )


def _cells(classes: Expr, cores: Expr) -> Expr:
    """Classes that are duplicates of one another by their sizes alone, else single
    classes: struct(key, core, k, p, members), ordered by (key, p)."""
    runs = group_runs(
        cores, lambda a, b: (a["p"] == b["p"]) & (a["key"] == b["key"])
    )
    first = lambda r: F.get(r, F.lit(0))
    split = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(
                F.size(first(r)["core"]) > first(r)["p"] * 8, F.array(r)
            ).otherwise(F.transform(r, lambda c: F.array(c))),
        )
    )
    return F.transform(
        split,
        lambda r: F.struct(
            first(r)["key"].alias("key"),
            first(r)["core"].alias("core"),
            F.size(first(r)["core"]).alias("k"),
            first(r)["p"].alias("p"),
            F.sort_array(
                F.flatten(F.transform(r, lambda c: F.get(classes, c["sid"])["members"]))
            ).alias("members"),
        ),
    )


def _families(cells: Expr) -> Expr:
    """Cells of one core: struct(fid, core, k, n, bits, of), where ``of`` lists the cells
    by their number of private words and n is the smallest size."""
    placed = F.transform(
        cells, lambda c, i: F.struct(c["key"].alias("key"), c["p"].alias("p"), i.alias("cell"))
    )
    runs = group_runs(placed, lambda a, b: a["key"] == b["key"])

    def bits(core: Expr) -> Expr:
        """Parity of the words' hashes, in lanes of 64 bits."""
        hashed = F.transform(core, lambda w: F.xxhash64(w))
        bit = lambda lane, h: Expr(
            f"if(({h.text} & 64L) = {64 * lane}L, shiftleft(1L, cast({h.text} & 63L as int)), 0L)"
        )
        flip = lambda lane, acc, h: Expr(f"({acc.text} ^ {bit(lane, h).text})")
        return let(
            hashed,
            lambda hs: F.array(
                *(
                    F.aggregate(
                        hs,
                        F.lit(0).cast("bigint"),
                        partial(flip, lane),
                    )
                    for lane in range(LANES)
                )
            ),
        )

    def family(run: Expr, fid: Expr) -> Expr:
        head = F.get(cells, F.get(run, F.lit(0))["cell"])
        return let(
            head,
            lambda c: F.struct(
                fid.alias("fid"),
                c["core"].alias("core"),
                c["k"].alias("k"),
                (c["k"] + c["p"]).alias("n"),
                bits(c["core"]).alias("bits"),
                F.transform(
                    group_runs(run, lambda a, b: a["p"] == b["p"]),
                    lambda r: F.struct(
                        F.get(r, F.lit(0))["p"].alias("p"),
                        F.transform(r, lambda x: x["cell"]).alias("cells"),
                    ),
                ).alias("of"),
            ),
        )

    return F.transform(runs, family)


def _near_families(families: Expr) -> Expr:
    """Pairs of different cores that may hold duplicates: struct(a, b, shared)."""
    entries = F.flatten(
        F.transform(
            families,
            lambda f: F.transform(
                F.slice(f["core"], F.lit(1), F.greatest(f["k"] - _part(f["n"], 4, 5), F.lit(0))),
                lambda w, i: F.struct(
                    w.alias("word"),
                    f["n"].alias("n"),
                    f["fid"].alias("fid"),
                    (i < f["k"] - _part(f["n"], 8, 9)).alias("early"),
                ),
            ),
        )
    )
    runs = F.filter(
        group_runs(F.sort_array(entries), lambda a, b: a["word"] == b["word"]),
        lambda g: (F.size(g) > 1) & F.exists(g, lambda e: e["early"]),
    )

    def near(runs: Expr) -> Expr:
        met = F.flatten(
            F.transform(
                runs,
                lambda g, r: F.transform(
                    g, lambda e: F.struct(e["fid"].alias("fid"), r.alias("run"))
                ),
            )
        )
        probes = group_runs(F.sort_array(met), lambda a, b: a["fid"] == b["fid"])
        return F.flatten(F.transform(probes, lambda p: partners(runs, p)))

    def partners(runs: Expr, probe: Expr) -> Expr:
        """Families before this one, in order of size, that it links to."""

        def of(b: Expr) -> Expr:
            found = F.array_distinct(
                F.flatten(
                    F.transform(
                        probe,
                        lambda x: F.transform(
                            F.filter(
                                F.get(runs, x["run"]),
                                lambda e: e["early"]
                                & ((e["n"] < b["n"]) | ((e["n"] == b["n"]) & (e["fid"] < b["fid"])))
                                & (e["n"] * 5 > b["n"] * 4),
                            ),
                            lambda e: e["fid"],
                        ),
                    )
                )
            )
            possible = F.filter(found, lambda fid: let(F.get(families, fid), lambda a: may(a, b)))
            checked = F.transform(
                possible,
                lambda fid: F.struct(
                    fid.alias("a"),
                    b["fid"].alias("b"),
                    F.size(
                        F.array_intersect(F.get(families, fid)["core"], b["core"])
                    ).alias("shared"),
                ),
            )
            return F.filter(
                checked,
                lambda p: close_enough(p["shared"], F.get(families, p["a"])["n"], b["n"]),
            )

        return let(F.get(families, F.get(probe, F.lit(0))["fid"]), of)

    def may(a: Expr, b: Expr) -> Expr:
        """Whether the parities leave room for enough shared words."""
        differing = " + ".join(
            f"bit_count({a['bits'].text}[{i}] ^ {b['bits'].text}[{i}])" for i in range(LANES)
        )
        needed = _part(a["n"] + b["n"], 4, 9) + 1
        return Expr(f"({differing})") <= a["k"] + b["k"] - needed * 2

    return let(runs, near)


def _links(cells: Expr, families: Expr, near: Expr) -> Expr:
    """Linked cells in both directions: struct(cell, to, percent); -1 stands for none."""
    link = lambda a, b, percent: F.array(
        F.struct(a.alias("cell"), b.alias("to"), percent.alias("percent")),
        F.struct(b.alias("cell"), a.alias("to"), percent.alias("percent")),
    )
    cross = lambda x, y, percent: F.flatten(
        F.transform(
            x["cells"],
            lambda a: F.flatten(F.transform(y["cells"], lambda b: link(a, b, percent))),
        )
    )
    own = F.transform(
        cells,
        lambda c, i: F.struct(
            i.alias("cell"),
            F.when(F.size(c["members"]) > 1, i).otherwise(-1).alias("to"),
            percent_of(c["k"], c["k"] + c["p"], c["k"] + c["p"]).alias("percent"),
        ),
    )

    def inside(f: Expr) -> Expr:
        small = F.filter(f["of"], lambda x: x["p"] * 4 < f["k"])
        return let(
            small,
            lambda xs: F.flatten(
                F.transform(
                    xs,
                    lambda x, i: F.flatten(
                        F.transform(
                            F.filter(
                                F.slice(xs, i + 2, F.size(xs)),
                                lambda y: (x["p"] + y["p"]) * 4 < f["k"],
                            ),
                            lambda y: cross(x, y, percent_of(f["k"], f["k"] + x["p"], f["k"] + y["p"])),
                        )
                    ),
                )
            ),
        )

    def between(p: Expr) -> Expr:
        def of(q: Expr) -> Expr:
            a, b, shared = q["a"], q["b"], q["shared"]
            return F.flatten(
                F.transform(
                    a["of"],
                    lambda x: F.flatten(
                        F.transform(
                            F.filter(
                                b["of"],
                                lambda y: close_enough(shared, a["k"] + x["p"], b["k"] + y["p"]),
                            ),
                            lambda y: cross(
                                x, y, percent_of(shared, a["k"] + x["p"], b["k"] + y["p"])
                            ),
                        )
                    ),
                )
            )

        both = F.struct(
            F.get(families, p["a"]).alias("a"), F.get(families, p["b"]).alias("b"),
            p["shared"].alias("shared"),
        )
        return let(both, of)

    return F.concat(
        own,
        F.flatten(F.transform(families, inside)),
        F.flatten(F.transform(near, between)),
    )


def _linked(cells: Expr, links: Expr) -> Expr:
    """struct(members, links) of every cell; nothing, if none is linked."""
    by_cell = group_runs(F.sort_array(links), lambda a, b: a["cell"] == b["cell"])
    linked = F.transform(
        by_cell,
        lambda g, i: F.struct(
            F.get(cells, i)["members"].alias("members"),
            F.transform(
                F.filter(g, lambda x: x["to"] >= 0),
                lambda x: F.struct(x["to"].alias("cell"), x["percent"].alias("percent")),
            ).alias("links"),
        ),
    )
    return F.when(F.exists(links, lambda x: x["to"] >= 0), linked).otherwise(empty(CELL_DDL))


def _heads(cells: Expr) -> Expr:
    """Functions with later duplicates, with how many, and the place of the first pair.

    In the merged order of a cell's members and all their partners, what is not a member
    before a member is a partner before it (or itself), so counting needs no pair.
    """

    def of_cell(c: Expr, i: Expr) -> Expr:
        partners = F.flatten(
            F.transform(c["links"], lambda x: F.get(cells, x["cell"])["members"])
        )
        merged = F.sort_array(
            F.concat(
                F.transform(
                    partners,
                    lambda m: F.struct(m["ord"].alias("ord"), F.lit(0).alias("own"), F.lit(0).alias("at")),
                ),
                F.transform(
                    c["members"],
                    lambda m, at: F.struct(m["ord"].alias("ord"), F.lit(1).alias("own"), at.alias("at")),
                ),
            )
        )
        placed = F.filter(
            F.transform(
                merged,
                lambda e, r: F.struct(e["own"].alias("own"), e["at"].alias("at"), r.alias("r")),
            ),
            lambda e: e["own"] == 1,
        )
        n = F.aggregate(
            c["links"], F.lit(0), lambda acc, x: acc + F.size(F.get(cells, x["cell"])["members"])
        )
        counted = F.transform(
            placed,
            lambda e: let(
                F.get(c["members"], e["at"]),
                lambda m: F.struct(
                    m["ord"].alias("ord"), i.alias("cell"), m["line"].alias("line"),
                    m["name"].alias("name"), m["sid"].alias("sid"), m["loc"].alias("loc"),
                    (n - (e["r"] - e["at"])).alias("later"),
                ),
            ),
        )
        return F.when(
            F.size(c["links"]) > 0,
            F.filter(
                counted, lambda h: (h["later"] > 0) & (h["loc"] > fixed.DUPLICATE_MIN_LOC)
            ),
        ).otherwise(F.slice(counted, 1, 0))

    heads = F.sort_array(F.flatten(F.transform(cells, of_cell)))

    def numbered(heads: Expr) -> Expr:
        later = F.transform(heads, lambda h: h["later"].cast("bigint"))
        return let(
            running_sums(later),
            lambda before: F.transform(
                heads,
                lambda h, r: F.struct(
                    *(h[k].alias(k) for k in ("ord", "cell", "line", "name", "sid")),
                    h["later"].cast("bigint").alias("later"), F.get(before, r).alias("start"),
                ),
            ),
        )

    return let(heads, numbered)


def _cells_of(fns: Expr) -> Expr:
    return let(
        word_classes(fns),
        lambda classes: let(_cores(classes), lambda cores: _cells(classes, cores)),
    )


def _links_of(cells: Expr) -> Expr:
    return let(
        _families(cells),
        lambda families: let(
            _near_families(families), lambda near: _links(cells, families, near)
        ),
    )


def _found_of(cells: Expr, links: Expr) -> Expr:
    return let(
        _linked(cells, links),
        lambda linked: F.struct(linked.alias("cells"), _heads(linked).alias("heads")),
    )


#: The steps from a function table ``fns`` with words to ``found``, each an expression over
#: columns of steps before it. One expression would nest too deep for the analyzer; more
#: steps would copy a file's row more often.
STEPS: dict[str, Callable[[], Expr]] = {
    "_cells": lambda: _cells_of(F.col("fns")),
    "_links": lambda: _links_of(F.col("_cells")),
    "found": lambda: _found_of(F.col("_cells"), F.col("_links")),
}


def pair_count(found: Expr) -> Expr:
    """Duplicate pairs of a file, from the counts."""
    last = F.get(found["heads"], F.size(found["heads"]) - 1)
    return F.coalesce(last["start"] + last["later"], F.lit(0).cast("bigint"))


def head_blocks(found: Expr, least: int) -> Expr:
    """The heads in runs of neighbours with about ``least`` pairs, or as many as the file has
    functions in its cells, if more: struct(start, heads)."""
    functions = F.aggregate(
        found["cells"], F.lit(0), lambda acc, c: acc + F.size(c["members"])
    )

    def of(step: Expr) -> Expr:
        runs = group_runs(
            found["heads"],
            lambda a, b: F.floor(a["start"] / step) == F.floor(b["start"] / step),
        )
        return F.transform(
            runs, lambda r: F.struct(F.get(r, F.lit(0))["start"].alias("start"), r.alias("heads"))
        )

    whole = F.struct(F.lit(0).cast("bigint").alias("start"), found["heads"].alias("heads"))
    return (
        F.when(pair_count(found) > least, let(F.greatest(F.lit(least), functions), of))
        .when(F.size(found["heads"]) > 0, F.array(whole))
        .otherwise(F.slice(F.array(whole), 1, 0))
    )


def block_pairs(cells: Expr, heads: Expr) -> Expr:
    """The pairs of some heads in (i, j) order."""

    def of_link(h: Expr, x: Expr) -> Expr:
        return F.transform(
            F.filter(F.get(cells, x["cell"])["members"], lambda m: m["ord"] > h["ord"]),
            lambda m: F.struct(
                h["ord"].alias("i"), m["ord"].alias("j"), h["line"].alias("line"),
                h["name"].alias("first"), m["name"].alias("second"),
                F.when(m["sid"] == h["sid"], 100).otherwise(x["percent"]).alias("percent"),
            ),
        )

    def later(h: Expr) -> Expr:
        return let(
            F.get(cells, h["cell"])["links"],
            lambda links: F.when(F.size(links) == 1, of_link(h, F.get(links, F.lit(0)))).otherwise(
                F.sort_array(F.flatten(F.transform(links, lambda x: of_link(h, x))))
            ),
        )

    return F.flatten(F.transform(heads, later))
