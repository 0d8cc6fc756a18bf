"""Near-duplicate functions of one file.

The search runs inside the file's row, for files of any size: its work follows the
number of functions and of linked families, not of pairs (``functions.similar``). Pairs
are made as rows afterwards, a bounded block of them at a time, so no row holds all pairs.
Files are told apart by their rows, so a repeated ``file_id`` changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similar
from ..functions import sqltext as E
from ..functions.arrays import group_runs
from ..functions.dialect import CORE, Dialect
from ..functions.metrics import token_jaccard
from .functions import explode_rows, posexplode_rows, with_functions

COLUMNS = ("i", "j", "line", "first", "second", "percent")
#: Pairs of a block, about; a file with more functions has larger blocks.
BLOCK_PAIRS = 4096


def with_duplicates(found: DataFrame) -> DataFrame:
    """Add ``found`` (``similar.FOUND_DDL``) to files with a function table and its words."""
    kept = found.columns
    for name, step in similar.STEPS.items():
        found = found.select("*", step().alias(name).column)
    return found.select(*kept, "found")


def found_duplicates(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Rows (file_id, found): what is found of each file's duplicates."""
    return with_duplicates(with_functions(files, profile, ("words",)).select("file_id", "fns"))


def duplicate_families(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Rows (file_id, a, b, percent, within): each pair of a member of ``a`` and one of ``b``
    is a duplicate. Within a family ``a`` and ``b`` are one list; members with one ``sid``
    have equal word sets, which are alike by 100 percent."""
    linked = posexplode_rows(
        found_duplicates(files, profile), E.col("found.cells"), "cell", "c",
        "file_id", F.col("found.cells").alias("cells"),
    )
    links = explode_rows(linked, E.col("c.links"), "x", "file_id", "cells", "cell", "c")
    return links.filter("cell <= x.cell").select(
        "file_id", F.col("c.members").alias("a"),
        F.get("cells", F.col("x.cell"))["members"].alias("b"),
        "x.percent", (F.col("cell") == F.col("x.cell")).alias("within"),
    )


def duplicate_groups(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Rows (file_id, a, b, percent, copies) of equal or similar word sets: each pair of
    ``a`` and ``b`` is a duplicate; of copies, ``a`` and ``b`` are one list. A family gives
    a row for each two of its word sets, so ``duplicate_families`` is the shorter form."""
    sets = lambda members: group_runs(
        E.sort_array(
            E.transform(
                E.col(members),
                lambda m: E.struct(
                    *(m[k].alias(k) for k in ("sid", "ord", "loc", "line", "name"))
                ),
            )
        ),
        lambda x, y: x["sid"] == y["sid"],
    )
    families = duplicate_families(files, profile)
    some = explode_rows(
        families.withColumn("sets_b", sets("b").column), sets("a"), "x",
        "file_id", "percent", "within", "sets_b",
    )
    both = explode_rows(some, E.col("sets_b"), "y", "file_id", "percent", "within", "x").select(
        "file_id", "percent", "within", F.col("x").alias("a"), F.col("y").alias("b")
    )
    first, second = F.col("a")[0]["sid"], F.col("b")[0]["sid"]
    copies = F.col("within") & (first == second)
    return both.filter(~F.col("within") | (first < second) | (copies & (F.size("a") > 1))).select(
        "file_id", "a", "b", F.when(copies, 100).otherwise(F.col("percent")).alias("percent"),
        copies.alias("copies"),
    )


def duplicate_pairs(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Rows (file_id, i, j, line, first, second, percent), i before j."""
    blocks = explode_rows(
        found_duplicates(files, profile), similar.head_blocks(E.col("found"), BLOCK_PAIRS), "b",
        "file_id", F.col("found.cells").alias("cells"),
    )
    pairs = similar.block_pairs(E.col("cells"), E.col("b.heads"))
    return explode_rows(blocks, pairs, "p", "file_id").select(
        "file_id", *(f"p.{k}" for k in COLUMNS)
    )


def duplicate_counts(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Rows (file_id, duplicates): the number of pairs, of which none is made."""
    return found_duplicates(files, profile).select(
        "file_id", similar.pair_count(E.col("found")).alias("duplicates").column
    )


def listed_pairs(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """The same rows as ``duplicate_pairs``, from one list in the file's row."""
    pairs = similar.block_pairs(E.col("found.cells"), E.col("found.heads"))
    return explode_rows(found_duplicates(files, profile), pairs, "p", "file_id").select(
        "file_id", *(f"p.{k}" for k in COLUMNS)
    )


def body_similarity(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Each function's word set against the next function's, with the set sizes."""
    fns = E.col("fns")
    neighbours = E.transform(
        E.slice(fns, 1, E.greatest(E.size(fns) - 1, 0)),
        lambda f, i: E.struct(
            f["ord"].alias("i"),
            f["words"].alias("a"),
            E.get(fns, i + 1)["words"].alias("b"),
        ),
    )
    return explode_rows(
        with_functions(files, profile, ("words",)), neighbours, "p", "file_id"
    ).select(
        "file_id",
        "p.i",
        F.size(F.array_intersect("p.a", "p.b")).alias("shared"),
        F.size(F.array_union("p.a", "p.b")).alias("combined"),
        token_jaccard(E.col("p.a"), E.col("p.b")).alias("similarity").column,
    )
