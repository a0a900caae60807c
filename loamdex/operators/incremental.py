"""Incremental maintenance: what a new scan changes in an index, and the rows of the next snapshot.

Parquet tables aren't updated in place. A new snapshot is written of the rows of unchanged files and those of changed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(existing: DataFrame, scanned: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """path, was, now, outcome. existing: path, content_hash, index_status. scanned: path, content_hash, index_status. Only the content decides whether a file
    has changed; time and size don't. With candidates (path), other paths stay as they are.

    outcome: unchanged, added, updated, deleted, none; removed files count as deleted if they were indexed.
    """
    e = existing.select("path", F.col("content_hash").alias("old_hash"), F.col("index_status").alias("was"))
    s = scanned.select("path", F.col("content_hash").alias("new_hash"), F.col("index_status").alias("now"))
    if candidates is not None:
        only = candidates.select("path").distinct()
        e, s = e.join(only, "path", "left_semi"), s.join(only, "path", "left_semi")
    both = e.join(s, "path", "full_outer")
    gone, same = F.col("now").isNull(), F.col("old_hash") == F.col("new_hash")
    outcome = (F.when(gone, F.when(F.col("was") == "indexed", "deleted").otherwise("none")).when(same, "unchanged")
               .when(F.col("now") == "indexed", F.when(F.coalesce(F.col("was"), F.lit("skipped")) == "skipped", "added").otherwise("updated"))
               .when(F.col("was") == "indexed", "deleted").otherwise("none"))
    return both.select("path", "was", "now", outcome.alias("outcome"), gone.alias("removed"))


def update_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "deleted", "unchanged")), F.count_if((F.col("now") == "skipped") & (F.col("outcome") != "unchanged")).alias("skipped"))


def removed_paths(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    return existing.join(scanned.select("path"), "path", "left_anti").select("path", "index_status")


def next_rows(table: DataFrame, fresh: DataFrame, outcomes: DataFrame, key: str = "path") -> DataFrame:
    """The rows of a table in the next snapshot: those of untouched paths, and the fresh ones."""
    touched = outcomes.where((F.col("outcome") != "unchanged") | F.col("removed")).select(F.col("path").alias(key))
    return table.join(touched, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def set_digest(entries: Column) -> Column:
    """SHA-256 of a set of strings: sorted, joined by NUL."""
    return F.sha2(F.array_join(F.array_sort(entries), "\0"), 256)


def dirty_entry(path: Column, content_hash: Column) -> Column:
    """path, a tab and the content's hash; - stands for a file that isn't there."""
    return F.concat(path, F.lit("\t"), F.coalesce(content_hash, F.lit("-")))


def with_ids(rows: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Adds ids start + 1, start + 2 ... in the given order. Rows are sorted and numbered in their partitions, and the partitions' counts added up, so no
    task sees all rows."""
    part = rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from pyspark.sql import Window

    part = part.persist()
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o", "_first")
    return part.join(offset, "_p").withColumn(name, (F.col("_o") + F.col("_m") - F.col("_first") + 1 + start).cast("bigint")).drop("_p", "_m", "_o", "_first")
