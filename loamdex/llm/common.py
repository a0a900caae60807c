"""Shared inputs of the training-data operators.

Every operator takes DataFrames with the columns of the project's tables and ignores any further columns, so
clashing extra names cannot reach a join. Repeated rows count once and only files whose current row is
``indexed`` are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines in one block of a file. A long file is spread over many blocks and never becomes one row.
BLOCK_LINES = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_files(files: DataFrame) -> DataFrame:
    """One row per file id, the one of the greatest mtime, if that is ``indexed``: file_id, path, language, extension,
    size. Rows without id are left out; of rows alike in mtime, the greatest in the other columns counts."""
    newest = files.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file_id")).agg(
        F.max(F.struct("mtime", "size", "path", "language", "extension", "index_status")).alias("r"))
    return newest.where(F.col("r.index_status") == "indexed").select(
        "file_id", F.col("r.path").alias("path"), F.col("r.language").alias("language"),
        F.col("r.extension").alias("extension"), F.col("r.size").alias("size"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """file_id, line, text without rows that lack a key; a null text is an empty line."""
    return lines.where(F.col("file_id").isNotNull() & F.col("line").isNotNull()).select(
        F.col("file_id").cast("bigint").alias("file_id"), F.col("line").cast("int").alias("line"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_blocks(lines: DataFrame, heads: DataFrame | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, block, n_lines, text[, head]: the distinct lines of each block in order, joined by line ends.

    One shuffle on (file_id, block), so that a file with a third of all lines is spread like any other data. heads (file_id, head) goes through the
    same shuffle as line 0 of each file's first block; without it the text would have to move once more for a join. Of contradicting texts of one line
    the greatest in byte order counts.
    """
    rows = clean_lines(lines)
    if heads is not None:
        rows = rows.where("line >= 1").unionByName(heads.select("file_id", F.lit(0).alias("line"), F.col("head").alias("text")))
    # keeps the last of entries alike in line
    kept = F.filter("a", lambda x, i: (i == F.size("a") - 1) | (F.col("a")[i + 1]["line"] != x["line"]))
    out = (rows.groupBy("file_id", F.floor((F.greatest(F.col("line"), F.lit(1)) - 1) / block_lines).cast("int").alias("block"))
           .agg(F.array_sort(F.collect_set(F.struct("line", "text"))).alias("a")).withColumn("a", kept))
    if heads is None:
        return out.select("file_id", "block", F.size("a").alias("n_lines"), F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("text"))
    headed = F.col("a")[0]["line"] == 0
    body = F.when(headed, F.slice("a", F.lit(2), F.size("a"))).otherwise(F.col("a"))
    return (out.select("file_id", "block", F.when(headed, F.col("a")[0]["text"]).alias("head"), body.alias("a"))
            .select("file_id", "block", "head", F.size("a").alias("n_lines"), F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("text")))


def blocks_with_context(lines: DataFrame, before: int, after: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, block, first_line, before, own, after, more_before, more_after: a block's own text, and that of some lines of the neighbouring
    blocks. ``first_line`` is the number of the first own line; more_... tell whether there are such lines at all.

    Only lines within ``before`` and ``after`` of a block's end are sent twice, so the volume stays that of the lines.
    """
    if block_lines < max(before, after):
        raise ValueError("a block must have as many lines as are taken from its neighbours")
    rows = clean_lines(lines)
    at = F.floor((F.col("line") - 1) / block_lines).cast("int")
    place = F.pmod(F.col("line") - 1, F.lit(block_lines))
    blocks = F.array_compact(F.array(at, F.when((place < after) & (at > 0), at - 1), F.when(place >= block_lines - before, at + 1)))
    part = lambda cond: F.array_join(F.transform(F.filter("a", cond), lambda x: x["text"]), "\n")
    first, last = F.col("block") * block_lines + 1, (F.col("block") + 1) * block_lines
    kept = F.filter("a", lambda x, i: (i == F.size("a") - 1) | (F.col("a")[i + 1]["line"] != x["line"]))
    return (rows.select("file_id", "line", "text", F.explode(blocks).alias("block"))
            .groupBy("file_id", "block").agg(F.array_sort(F.collect_set(F.struct("line", "text"))).alias("a"))
            .withColumn("a", kept)
            .select("file_id", "block", first.alias("first_line"), part(lambda x: x["line"] < first).alias("before"), part(lambda x: x["line"].between(first, last)).alias("own"),
                    part(lambda x: x["line"] > last).alias("after"), F.exists("a", lambda x: x["line"] < first).alias("more_before"),
                    F.exists("a", lambda x: x["line"] > last).alias("more_after"), F.exists("a", lambda x: x["line"].between(first, last)).alias("real"))
            .where("real").drop("real"))


def indexed_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of the indexed files."""
    return clean_lines(lines).join(current_files(files).select("file_id"), "file_id", "left_semi")


#: Most rows of a side that is broadcast; its rows have a few numbers each, so this is a few MB.
SMALL_ROWS = 200_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, marked for a broadcast if it has been counted and has at most ``most`` rows; beyond, the join shuffles both sides. df is kept, so counting
    it costs nothing twice."""
    kept = df.persist()
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept
