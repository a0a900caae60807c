"""Streams: changes of files applied to an index as they arrive, and rates of the run log with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import reconcile, with_ids
from ..plans.build import derive, next_tables
from ..sources.snapshot import Store

#: What a change carries: a scanned row of a file, or a deletion (a null content_hash).
CHANGE = "path string, language string, extension string, size bigint, mtime bigint, content_hash string, index_status string, source_encoding string, encoding_source string, transcoded int, skip_reason string, text string"


def apply_changes(store: Store) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of several changes of a path the newest by mtime counts, contents that are there already change nothing, and each batch is one
    new snapshot."""

    def run(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        columns = [c.split()[0] for c in CHANGE.split(", ")]
        newest = batch.groupBy("path").agg(F.max_by(F.struct(*columns), F.coalesce("mtime", F.lit(0))).alias("r")).select("r.*").persist()
        if newest.isEmpty():
            return
        x = store.read(spark)
        there = newest.where("content_hash is not null")
        outcomes = reconcile(x.files, there, newest.select("path")).persist()
        changed = there.join(outcomes.where("outcome <> 'unchanged'").select("path"), "path", "left_semi")
        top, first = (d.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for d in (x.files, x.symbols))
        fresh = derive(with_ids(changed, ["path"], start=top))
        fresh["symbols"] = with_ids(fresh["symbols"], ["path", "line", "column", "kind", "name"], start=first)
        store.publish(next_tables(x, fresh, outcomes) | {"meta": x.meta, "components": x.components})
        newest.unpersist()

    return run


def run_rates(runs: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs per root, status and window of their start, over a stream of the run log; rows that come later than ``late`` are dropped by the watermark."""
    at = runs.withColumn("at", F.to_timestamp("started_at"))
    return (at.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "root", "status").agg(F.count(F.lit(1)).alias("runs"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "root", "status", "runs"))
