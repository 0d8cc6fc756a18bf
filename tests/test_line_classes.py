"""Conditional expressions by line, and the classes that find line ends."""

import re

import pytest

from srcgauge.functions import metrics as M
from srcgauge.functions import spans
from srcgauge.functions.dialect import CORE, SERVICE
from srcgauge.functions.text import PY
from srcgauge.operators import functions

DDL = "file_id int, filename string, code string"


def test_conditional_expressions_count_once_a_line(spark):
    """Whatever ends a line, and whatever stands around the two words."""
    texts = {
        "a if b else c if d else e": 1,
        "a if b": 0,
        "else if b": 0,
        "if\nelse": 0,
        "if\relse": 0,
        "if\u2028else": 0,
        "if\u2029else": 0,
        "if\x85else": 1,
        "if else": 1,
        "iff else": 0,
        "if elsewhere": 0,
        "if elsewhere else": 1,
        "x if y else z\r\nx if y else z\n\nx if y": 2,
        "\U0001f600 if \U0001f600 else": 1,
        "": 0,
        "x if y " * 100_000: 0,
    }
    df = spark.createDataFrame([(i, "a.py", t) for i, t in enumerate(texts)], DDL)
    counts = functions.decision_counts(df, "python").collect()
    got = {r.file_id: r.if_else for r in counts}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("d", [CORE, SERVICE])
def test_negated_classes_hold_one_wide_item(d):
    patterns = [d.line_start, spans.py_pattern(d), *spans.js_patterns(d)]
    patterns += M.decision_patterns(PY, d).values()
    for negated in re.findall(r"\[\^([^\[\]]*)\]", " ".join(patterns)):
        assert len(re.findall(r"\\u[0-9a-f]{4}(?:-\\u[0-9a-f]{4})?", negated)) <= 1, negated
