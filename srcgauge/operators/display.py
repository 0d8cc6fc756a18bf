"""Display attributes of results, as lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*map(F.lit, chain.from_iterable(values.items())))
    return F.try_element_at(pairs, key)


def severity_icon(severity: Column) -> Column:
    return F.coalesce(_lookup(fixed.SEVERITY_ICONS, severity), F.lit(""))


def priority_color(priority: Column) -> Column:
    return _lookup(fixed.PRIORITY_COLORS, priority)


def issue_count_color(count: Column) -> Column:
    return F.when(count > 0, fixed.ISSUES_SOME).otherwise(fixed.ISSUES_NONE)


def suggestion_count_color(count: Column) -> Column:
    return F.when(count > 0, fixed.SUGGESTIONS_SOME).otherwise(fixed.SUGGESTIONS_NONE)


def file_badge(filename: Column, language: Column) -> Column:
    return F.concat(filename, F.lit(" ("), language, F.lit(")"))


def function_label(start: Column, loc: Column, params: Column) -> Column:
    return F.concat(
        F.lit("L"), start, F.lit(" | "), loc, F.lit(" LOC | "), params, F.lit("p")
    )
