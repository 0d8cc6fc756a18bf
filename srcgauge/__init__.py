"""Static code metrics in bulk, as Spark column expressions and plans.

Scalar operators take column names (or SQL expressions) and return a Column;
the others take and return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column

from .functions import findings, metrics, text
from .functions.dialect import dialect
from .functions.sqltext import col
from .operators.duplicates import duplicate_pairs
from .operators.files import file_summary, supported, unsupported
from .operators.functions import functions_all
from .plans.analysis import analyze, lint_all, refactor_all, result_json

__all__ = [
    "analyze",
    "case_count",
    "cc_level",
    "cyclomatic",
    "duplicate_pairs",
    "file_summary",
    "functions_all",
    "halstead",
    "language_detect",
    "lint_all",
    "maintainability",
    "mi_level",
    "refactor_all",
    "result_json",
    "strip_noise",
    "supported",
    "unsupported",
]


def language_detect(filename: str) -> Column:
    return text.language_detect(col(filename)).column


def strip_noise(code: str, lang: str, profile: str = "core") -> Column:
    return text.strip_noise(col(code), col(lang), dialect(profile)).column


def cyclomatic(code: str, lang: str, profile: str = "core") -> Column:
    return metrics.cyclomatic(col(code), col(lang), dialect(profile)).column


def halstead(code: str, lang: str, profile: str = "core") -> Column:
    return metrics.halstead(col(code), col(lang), dialect(profile)).column


def maintainability(volume: str, cc: str, loc: str, profile: str = "core") -> Column:
    return metrics.maintainability(col(volume), col(cc), col(loc), dialect(profile)).column


def cc_level(cc: str) -> Column:
    return metrics.cc_level(col(cc)).column


def mi_level(mi: str) -> Column:
    return metrics.mi_level(col(mi)).column


def case_count(code: str, lang: str, profile: str = "core") -> Column:
    return findings.case_count(col(code), col(lang), dialect(profile)).column
