"""Small helpers for array columns.

Spark shares common subexpressions between columns but not inside a lambda, so
``let`` binds a value once before it is used several times.
"""

from __future__ import annotations

from collections.abc import Callable

from . import sqltext as F
from .sqltext import Expr

def let(value: Expr, body: Callable[[Expr], Expr]) -> Expr:
    """Evaluate ``value`` once and build ``body`` on it.

    The finish step of an aggregate over nothing binds a variable without
    building and indexing an array, whose type Spark works out anew at each
    evaluation.
    """
    return F.aggregate(empty("int"), value, lambda bound, _: bound, body)


def empty(ddl: str) -> Expr:
    """An empty array of the given element type."""
    return F.array().cast(f"array<{ddl}>")


def first_of_runs(items: Expr, same: Callable[[Expr, Expr], Expr]) -> Expr:
    """Keep the first item of every run of neighbours that ``same`` calls equal."""
    return let(
        items,
        lambda xs: F.filter(
            xs, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(~same(F.get(xs, i - 1), x))
        ),
    )


def group_runs(items: Expr, same: Callable[[Expr, Expr], Expr]) -> Expr:
    """Cut an array into runs of neighbours that ``same`` calls equal (linear)."""

    def cut(xs: Expr) -> Expr:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: F.when(i == 0, F.lit(True)).otherwise(
                ~same(F.get(xs, i - 1), F.get(xs, i))
            ),
        )
        return let(
            heads,
            lambda hs: F.transform(
                hs,
                lambda h, k: F.slice(
                    xs, h + 1, F.coalesce(F.get(hs, k + 1), F.size(xs)) - h
                ),
            ),
        )

    return let(
        items,
        lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(
            F.transform(F.slice(xs, 1, 0), lambda x: F.array(x))
        ),
    )


def run_lengths(items: Expr) -> Expr:
    """The values of a sorted array with their counts: struct(value, n)."""

    def cut(xs: Expr) -> Expr:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: F.when(i == 0, F.lit(True)).otherwise(F.get(xs, i - 1) != F.get(xs, i)),
        )
        return let(
            heads,
            lambda hs: F.transform(
                hs,
                lambda h, k: F.struct(
                    F.get(xs, h).alias("value"),
                    (F.coalesce(F.get(hs, k + 1), F.size(xs)) - h).alias("n"),
                ),
            ),
        )

    return let(
        items,
        lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(
            F.transform(F.slice(xs, 1, 0), lambda x: F.struct(x.alias("value"), F.lit(0).alias("n")))
        ),
    )


def running_sums(numbers: Expr, block: int = 128) -> Expr:
    """The sum before each number, linear in the array's length.

    A fold that grows an array copies it at each step, so sums are taken over blocks, then
    over the blocks before a block and the numbers before a number in its block.
    """
    add = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")

    def within(blocks: Expr, totals: Expr) -> Expr:
        return F.flatten(
            F.transform(
                blocks,
                lambda b, k: let(
                    F.aggregate(F.slice(totals, 1, k), zero, add),
                    lambda before: F.transform(
                        b, lambda x, i: F.aggregate(F.slice(b, 1, i), before, add)
                    ),
                ),
            )
        )

    def cut(xs: Expr) -> Expr:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        blocks = F.transform(starts, lambda k: F.slice(xs, k * block + 1, F.lit(block)))
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, lambda b: F.aggregate(b, zero, add)), lambda totals: within(bs, totals)
            ),
        )

    return let(numbers, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(xs))
