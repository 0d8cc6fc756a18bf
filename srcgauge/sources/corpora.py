"""Code-like inputs that Spark derives from the given tables.

The tables hold prose, so two inputs are made from them: ``documents`` read as
files of nine name endings, and a corpus of real functions written out from the
numbers in ``part``. Both grow with their table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt, table

DOC_ENDINGS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "pyw", "md")
FUNCTIONS_PER_FILE = 5

# Pieces of the derived functions.
PY_PARAMS = ", p1: int = 1, p2: int = 2, p3: int = 3, p4: int = 4, p5: int = 5, p6: int = 6, p7: int = 7"
JS_PARAMS = ", p1, p2, p3, p4, p5, p6, p7"
NOTE = "adds the step for every unit and hands back the sum of all steps taken so far"


def documents_as_files(df: DataFrame) -> DataFrame:
    endings = F.array(*map(F.lit, DOC_ENDINGS))
    ending = F.get(endings, (F.col("doc_id") % len(DOC_ENDINGS)).cast("int"))
    return df.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), ending).alias("filename"),
        F.col("text").alias("code"),
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents_as_files(dealt(text))


def _when(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text)).otherwise(F.lit(""))


def _py_function(k: Column, size: Column) -> Column:
    depth = k % 7
    nested = [_when(depth >= i, f"{'    ' * i}if a > {i}:\n") for i in range(1, 7)]
    return F.concat(
        F.repeat(F.lit("\n"), (k % 3).cast("int")),
        F.lit("def f"), k, F.lit("(a"),
        F.substring(F.lit(PY_PARAMS), F.lit(1), 13 * (size % 8)),
        F.lit("):\n    # "), F.lit(NOTE), F.lit("\n"),
        F.repeat(F.lit("    if a and p1:  # note\n        return a\n"), (k % 6).cast("int")),
        *nested,
        F.repeat(F.lit(" "), (4 * (depth + 1)).cast("int")),
        F.lit("total = 'a' if a or p1 else 0\n"),
        F.repeat(F.concat(F.lit("    total = total + "), size, F.lit("\n")), 2 * size),
        _when(k % 11 == 0, "    match a:\n" + "        case 1:\n            total = 1\n" * 12),
        F.lit("    return total"),
    )


def _js_function(k: Column, size: Column) -> Column:
    name = F.concat(F.lit("f"), k)
    params = F.concat(F.lit("(a"), F.substring(F.lit(JS_PARAMS), F.lit(1), 4 * (size % 8)), F.lit(")"))
    head = (
        F.when(k % 4 == 0, F.concat(F.lit("function "), name, params, F.lit(" {\n")))
        .when(k % 4 == 1, F.concat(F.lit("const "), name, F.lit(" = "), params, F.lit(" => {\n")))
        .when(k % 4 == 2, F.concat(F.lit("async function "), name, params, F.lit(" {\n")))
        .otherwise(F.concat(name, F.lit(" = "), params, F.lit(" => {\n")))
    )
    return F.concat(
        head,
        F.lit("// "), F.lit(NOTE), F.lit("\n"),
        _when(
            k % 5 == 0,
            'let u = "http://x"; /* unit\n price */\n'
            "if (a ?? p) {\n  return 1;\n} else if (a ? p : a?.b) {\n  return `two`;\n}\n",
        ),
        F.repeat(F.lit("if (a > 1 && p) {\n"), (k % 7).cast("int")),
        F.repeat(F.concat(F.lit("total += "), size, F.lit("; // step\n")), 2 * size),
        _when(k % 11 == 0, "switch (a) {\n" + "case 1: break;\n" * 12 + "}\n"),
        F.lit("return total;\n"),
        F.repeat(F.lit("}\n"), (k % 7 + 1).cast("int")),
    )


def part_as_code(df: DataFrame) -> DataFrame:
    """One function per part, five functions per file, even files Python.

    Only the numbers are shuffled; the text is written after the shuffle. The
    partition count is given, or AQE would merge such small rows into one task.
    """
    k, size = F.col("p_partkey"), F.col("p_size")
    even = F.col("file_id") % 2 == 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.select(k, F.floor(k / FUNCTIONS_PER_FILE).alias("file_id"), size)
        .repartition(partitions, "file_id")
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct(k, size))).alias("parts"))
        .select(
            "file_id",
            F.concat(
                F.lit("file_"), "file_id", F.when(even, F.lit(".py")).otherwise(F.lit(".js"))
            ).alias("filename"),
            F.array_join(
                F.transform(
                    "parts",
                    lambda p: F.when(even, _py_function(p["p_partkey"], p["p_size"])).otherwise(
                        _js_function(p["p_partkey"], p["p_size"])
                    ),
                ),
                "\n",
            ).alias("code"),
        )
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_as_code(table(spark, sf_dir, "part"))


# -- saved pages --------------------------------------------------------------
def _escaped(code: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        code = F.replace(code, F.lit(plain), F.lit(entity))
    return code


def files_as_pages(files: DataFrame) -> DataFrame:
    """Code files written out as saved file pages in five layouts. The last one has
    elements inside each other, and only its elements tell that it is a file and
    which."""
    lines = F.split(_escaped(F.col("code")), "\n", -1)

    def rows(before: Column | str, after: str, number: bool = False) -> Column:
        return F.array_join(
            F.transform(
                lines,
                lambda text, i: F.concat(
                    F.lit(before),
                    *([i + 1, F.lit('"></td><td class="blob-code blob-code-inner">')] if number else []),
                    text,
                    F.lit(after),
                ),
            ),
            "",
        )

    layout = F.col("file_id") % 5
    body = (
        F.when(layout == 0, rows('<tr><td data-line-number="', "</td></tr>", number=True))
        .when(
            layout == 1,
            rows(
                '<div class="react-code-line-contents"><div class="react-code-text x">',
                "</div></div>",
            ),
        )
        .when(
            layout == 2,
            F.concat(F.lit('<div class="blob-wrapper"><pre>'), _escaped(F.col("code")), F.lit("</pre></div>")),
        )
        .when(
            layout == 3,
            F.concat(F.lit('<div class="data highlight">'), _escaped(F.col("code")), F.lit("</div>")),
        )
        .otherwise(
            F.concat(
                F.lit("<ul data-testid='breadcrumbs'><li>src<li>"), "filename",
                F.lit("</ul><main data-hpc><div class='a react-code-lines'><div><div>"),
                F.replace(_escaped(F.col("code")), F.lit("\n"), F.lit("</div>\n<div>")),
                F.lit("</div></div></div></main>"),
            )
        )
    )
    where = F.when(layout == 4, F.lit("view")).otherwise(F.concat(F.lit("blob/main/src/"), "filename"))
    return files.select(
        F.col("file_id").alias("page_id"),
        F.concat(
            F.lit("https://code.example.com/team"), F.col("file_id") % 10,
            F.lit("/project/"), where,
        ).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><body>"), body, F.lit("</body></html>")).alias("html"),
    )


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the derived corpus (kind ``code``) with the given ``pages``."""
    given = table(spark, sf_dir, "pages").select(
        F.lit("web").alias("kind"), "page_id", "url", "html"
    )
    code = files_as_pages(code_files(spark, sf_dir)).select(
        F.lit("code").alias("kind"), "page_id", "url", "html"
    )
    return given.unionByName(code)
