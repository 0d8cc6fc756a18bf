"""Heat regions, coloured lines and badges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fntable, metrics
from ..functions import sqltext as E
from ..functions.arrays import first_of_runs, group_runs, let
from ..functions.dialect import CORE, Dialect
from ..functions.text import line_total
from .files import CODE
from .functions import exploded, explode_rows, with_functions

_PLACE_BITS = 31
_PLACES = 1 << _PLACE_BITS


def heat_intensity(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    return exploded(files, profile, ("cc",)).select(
        "file_id", "f.ord", "f.name", "f.cyclomaticComplexity", "f.heatIntensity"
    )


def heatmap_regions(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    return (
        exploded(files, profile, ("cc",))
        .select("file_id", "f.ord", fntable.heat_region(E.col("f")).alias("h").column)
        .select("file_id", "ord", "h.*")
    )


def heat_lines(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """One row per region and covered line, clipped to the file."""
    regions = (
        explode_rows(
            with_functions(files, profile, ("cc",)).withColumn("total", line_total(CODE).column),
            E.col("fns"), "f", "file_id", "total",
        )
        .select("file_id", "total", "f.ord", fntable.heat_region(E.col("f")).alias("h").column)
    )
    return regions.select(
        "file_id",
        "ord",
        "h.name",
        F.explode(F.sequence(F.col("h.startLine"), F.least(F.col("h.endLine"), F.col("total")))).alias("line"),
        "h.intensity",
        "h.color",
    )


def _winners(fns: E.Expr, total: E.Expr) -> E.Expr:
    """Per covered line the last region's place in ``fns``: array of line * 2^31 + place.

    Regions and lines are paired as whole numbers that sort by line and then by
    falling place, so the first of each line is the last region.
    """
    pairs = E.flatten(
        E.transform(
            fns,
            lambda f: E.transform(
                E.sequence(f["startLine"], E.least(f["endLine"], total)),
                lambda line: line.cast("bigint") * _PLACES + (E.lit(_PLACES - 1) - f["ord"]),
            ),
        )
    )
    first = first_of_runs(
        E.sort_array(pairs),
        lambda a, b: E.shiftright(a, _PLACE_BITS) == E.shiftright(b, _PLACE_BITS),
    )
    return E.transform(first, lambda c: c - c % _PLACES + (E.lit(_PLACES - 1) - c % _PLACES))


def heat_overlay(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """The colour of every covered line; the last region wins.

    Chosen in the file's row: only winning lines leave it, without a shuffle.
    """
    coloured = E.transform(
        _winners(E.col("fns"), line_total(CODE)),
        lambda c: let(
            fntable.heat_region(E.get(E.col("fns"), (c % _PLACES).cast("int"))),
            lambda h: E.struct(
                E.shiftright(c, _PLACE_BITS).cast("int").alias("line"),
                h["name"].alias("name"),
                h["color"].alias("color"),
                h["intensity"].alias("intensity"),
            ),
        ),
    )
    return explode_rows(with_functions(files, profile, ("cc",)), coloured, "t", "file_id").select(
        "file_id",
        "t.line",
        "t.name",
        "t.color",
        *(metrics.rgb_part(E.col("t.color"), i).alias(c).column for i, c in enumerate("rgb")),
        metrics.heat_alpha(E.col("t.intensity")).alias("alpha").column,
    )


def badge_rows(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """One badge per start line: the last region's complexity with the level
    label of the first function of that name. Both picks are sorts in the row.
    """
    by_name = group_runs(
        E.sort_array(
            E.transform(
                E.col("fns"),
                lambda f: E.struct(
                    f["name"].alias("name"),
                    f["ord"].alias("ord"),
                    f["startLine"].alias("line"),
                    f["cyclomaticComplexity"].alias("cc"),
                    f["complexityLevel"].alias("level"),
                ),
            )
        ),
        lambda a, b: a["name"] == b["name"],
    )
    labelled = E.flatten(
        E.transform(
            by_name,
            lambda g: E.transform(
                g,
                lambda f: E.struct(
                    f["line"].alias("line"),
                    (-f["ord"]).alias("last"),
                    f["name"].alias("name"),
                    f["cc"].alias("complexity"),
                    f["level"]["color"].alias("color"),
                    E.get(g, E.lit(0))["level"]["label"].alias("label"),
                ),
            ),
        )
    )
    badges = first_of_runs(E.sort_array(labelled), lambda a, b: a["line"] == b["line"])
    return explode_rows(
        with_functions(files, profile, ("cc",)), badges, "b", "file_id"
    ).select(
        "file_id",
        F.col("b.line").alias("startLine"),
        "b.name",
        F.concat(F.lit("CC: "), F.col("b.complexity")).alias("badge"),
        "b.color",
        "b.label",
    )
