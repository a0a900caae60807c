"""The index's tables as they are stored, cleaned of repeats and outdated rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS

FILE_COLUMNS = [f.name for f in SCHEMAS["files"].fields]


@dataclass
class Index:
    """The tables of one snapshot. Every query of a command reads the same one."""

    files: DataFrame
    lines: DataFrame
    symbols: DataFrame
    metrics: DataFrame
    runs: DataFrame | None = None
    meta: DataFrame | None = None
    components: DataFrame | None = None
    symbols_postings: DataFrame | None = None
    files_postings: DataFrame | None = None
    #: The keys of the lines, each once, for what needs no text.
    line_keys: DataFrame | None = None

    def views(self) -> None:
        """Registers the tables under the names that SQL of users may use."""
        for name, df in (("files", self.files), ("lines", self.lines), ("symbols", self.symbols), ("file_metrics", self.metrics), ("build_runs", self.runs), ("meta", self.meta), ("components", self.components)):
            if df is not None:
                df.createOrReplaceTempView(name)


def newest_files(files: DataFrame) -> DataFrame:
    """The row of the greatest mtime of each file; of rows alike in it, the greatest in the other columns, in the order of the table. Id and path both stand
    for the file, so a filter on either reaches the scan."""
    key = ["id", "path"]
    rest = [c for c in FILE_COLUMNS if c not in (*key, "mtime")]
    return files.groupBy(*key).agg(F.max(F.struct("mtime", *rest)).alias("r")).select(*(F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in FILE_COLUMNS))


def read_index(spark: SparkSession, folder: str) -> Index:
    """The tables of a folder of Parquet files, with the lines under the name ``file_lines``. Repeated rows count once: they are alike in all columns, which are
    all keys of the grouping, so the filters of a query are carried out below it, in the scan where they can be."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    pick = lambda name, table: read(name).select(*(f.name for f in SCHEMAS[table].fields))
    return Index(newest_files(read("files")), pick("file_lines", "lines").distinct(), pick("symbols", "symbols").distinct(), pick("file_metrics", "file_metrics").distinct(), pick("build_runs", "build_runs").distinct(),
                 line_keys=read("file_lines").select("file_id", "line").distinct())
