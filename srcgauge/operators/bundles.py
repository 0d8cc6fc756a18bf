"""Function ends in files that are too large for one row.

The row form walks over a file's braces in order. Here a file is rows of lines, cut into
chunks of neighbouring lines. Each chunk is reduced to its change of depth, a prefix sum
over the chunks gives the depth at which each one begins, and then chunks are searched on
their own: the end of a function is the next brace that leaves its depth. What a chunk
doesn't hold is looked up among the first such braces of the chunks after it, a table of a
row per chunk and depth. No task holds more than a chunk's braces or that table of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: Lines of a chunk.
CHUNK_LINES = 20_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line, text) of text files below ``path``, which splits of a file give apart.

    Lines are numbered from the splits' line counts. An empty line behind the last newline
    is not a row.
    """
    raw = spark.read.option("lineSep", "\n").text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.replace(F.col("value"), F.lit("\r"), F.lit("")).alias("text"),
    )
    split = Window.partitionBy("file_id", "_split").orderBy("_at")
    counts = raw.groupBy("file_id", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("file_id", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = raw.withColumn("_row", F.row_number().over(split)).join(first, ["file_id", "_split"])
    return placed.select("file_id", (F.col("_first") + F.col("_row")).cast("int").alias("line"), "text")


def _later(found: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """For each (keys, chunk) of ``asked``: ``pos`` of ``found`` in the nearest chunk after it."""
    both = found.select(*keys, "chunk", "pos").unionByName(
        asked.select(*keys, "chunk").distinct(), allowMissingColumns=True
    )
    # From the last chunk back; a chunk's question comes before its own answer.
    back = Window.partitionBy(*keys).orderBy(F.desc("chunk"), F.col("pos").isNotNull())
    seen = back.rowsBetween(Window.unboundedPreceding, -1)
    answered = both.withColumn("_later", F.last("pos", ignorenulls=True).over(seen))
    return answered.filter("pos is null").select(*keys, "chunk", F.col("_later").alias("pos"))


def brace_ends(lines: DataFrame, starts: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file_id, line, endLine) of functions that start at lines of JavaScript files.

    ``lines``: (file_id, line, text), ``starts``: (file_id, line); both without nulls, and a
    start counts once. The end is the first line on which, a brace having been opened,
    the depth is that before the start line, else the usual number of lines further on.
    """
    chunk = F.floor((F.col("line") - 1) / chunk_lines).alias("chunk")
    braces = lines.select("file_id", "line", F.regexp_replace("text", "[^{}]+", "").alias("b"))
    events = braces.filter("b <> ''").select(
        "file_id", chunk, "line", F.posexplode(F.split("b", "")).alias("at", "c")
    )
    events = events.filter(F.col("c") != "").select(
        "file_id", "chunk", "line", "at", F.when(F.col("c") == "{", 1).otherwise(-1).alias("step")
    )
    asked = starts.select("file_id", "line").distinct().select(
        "file_id", chunk, "line", F.lit(-1).alias("at"), F.lit(0).alias("step")
    )
    marks = events.unionByName(asked)

    part = Window.partitionBy("file_id", "chunk")
    changes = marks.groupBy("file_id", "chunk").agg(F.sum("step").alias("change"))
    earlier = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    depths = changes.select(
        "file_id", "chunk", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("before")
    )
    pos = F.struct("line", "at")
    onward = part.orderBy("line", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = part.orderBy(F.desc("line"), F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = F.when(F.col("step") == 1, pos)
    placed = (
        marks.withColumn("local", F.sum("step").over(onward))
        .withColumn("opens", F.last(opening, ignorenulls=True).over(back))
        .join(depths, ["file_id", "chunk"])
        .select("file_id", "chunk", pos.alias("pos"), "step", "opens",
                (F.col("local") + F.col("before")).alias("depth"))
    )

    # The first opening brace at or after each start.
    begun = placed.filter("step = 0")
    opened = placed.filter("step = 1").groupBy("file_id", "chunk").agg(F.min("pos").alias("pos"))
    further = _later(opened, begun.filter("opens is null"), "file_id")
    begun = begun.join(further.withColumnRenamed("pos", "_further"), ["file_id", "chunk"], "left").select(
        "file_id", F.col("pos.line").alias("start"), "depth",
        F.coalesce("opens", "_further").alias("pos"),
    )
    begun = begun.withColumn("chunk", F.floor((F.col("pos.line") - 1) / chunk_lines))

    # From there on, the first brace that leaves the depth of the start.
    leaves = placed.filter("step <> 0").select("file_id", "chunk", "depth", "pos")
    both = leaves.withColumn("start", F.lit(None).cast("int")).unionByName(
        begun.filter("pos is not null").select("file_id", "chunk", "depth", "pos", "start")
    )
    level = Window.partitionBy("file_id", "chunk", "depth").orderBy(
        F.desc("pos"), F.col("start").isNotNull()
    )
    ends = F.last(F.when(F.col("start").isNull(), F.col("pos")), ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = both.withColumn("end", ends).filter("start is not null")
    firsts = leaves.groupBy("file_id", "depth", "chunk").agg(F.min("pos").alias("pos"))
    further = _later(firsts, here.filter("end is null"), "file_id", "depth")
    closed = here.join(
        further.withColumnRenamed("pos", "_further"), ["file_id", "depth", "chunk"], "left"
    ).select(
        "file_id", F.col("start").alias("line"), F.coalesce("end.line", "_further.line").alias("_end")
    )
    sizes = lines.groupBy("file_id").agg(F.max("line").alias("_lines"))
    reached = F.least(F.col("line") - 1 + fixed.FALLBACK_LINES, F.col("_lines"))
    return (
        asked.select("file_id", "line")
        .join(closed, ["file_id", "line"], "left")
        .join(sizes, "file_id")
        .select("file_id", "line", F.coalesce("_end", reached).cast("int").alias("endLine"))
    )
