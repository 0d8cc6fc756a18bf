"""A corpus pipeline over ``documents``: language, toxicity, near-duplicates, packing.

Each stage works on all that its predecessor kept; its result is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgauge.llm.catalog import WORD_BPE
from srcgauge.llm.common import remainder, stored
from srcgauge.llm.language import identify, train
from srcgauge.llm.neardup import near_duplicates
from srcgauge.llm.packing import pack_documents
from srcgauge.llm.toxicity import THRESHOLD, learned, score
from srcgauge.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Texts that are null or without a letter go, and those whose cross-entropy exceeds
    their language's limit. With nothing to learn from no row is recognised.
    """
    models = train(docs, remainder("doc_id", 4) != 2)
    return identify(docs, models, passed=COLUMNS).filter("not rejected").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.

    A null or empty text has the score of a text without n-grams. Rows are scored one by
    one: repeated rows and null ids stay as they are, an empty table gives no rows, extra
    columns are dropped, whatever their names. Learns from the documents that labels name.
    """
    model = learned(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = score(docs, model, passed=COLUMNS)
    return scored.filter(F.col("toxicity") < THRESHOLD).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8).

    The smallest id stays. Rows of one id with different texts are different documents:
    each is grouped by its own text, and of a group's rows of the smallest id the one with
    the least hash of its text stays. Repeated rows are one group. Rows without words or
    with a null id are in no group and stay. An empty table gives no rows; extra columns
    are dropped, whatever their names.
    """
    rows = docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")  # numbers stay the same when a task is run again
    groups = near_duplicates(
        rows.filter("doc_id is not null"), words_per_shingle=5, id_col="row"
    ).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct("doc_id", F.xxhash64("text").alias("hash"), "row"))
    kept = rows.join(groups, "row").groupBy("component_id").agg(first.alias("first"))
    stay = rows.join(kept.select("first.row"), "row", "left_semi")
    return stay.unionByName(rows.filter("doc_id is null")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences of 2048 tokens.

    A null or empty text is the end mark alone. Repeated rows and null ids are packed as
    often as they occur, an empty table gives no rows.
    """
    return pack_documents(docs, WORD_BPE)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("packing", packing),
]

#: SQL cannot express the models, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
