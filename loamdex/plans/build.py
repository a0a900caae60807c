"""Building an index: scan, derive, write; and bringing one up to date."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import with_metrics
from ..functions.text import split_lines
from ..model import POSTINGS, SCHEMA_VERSION, SCHEMAS, empty
from ..operators.fulltext import file_postings, symbol_postings
from ..operators.incremental import next_rows, reconcile, update_counts, with_ids
from ..operators.scanners import scanned_symbols
from ..operators.symbols import pattern_symbols
from ..sources import git
from ..sources.config import Config
from ..sources.snapshot import Store, now
from ..sources.tables import Index

FILE_SOURCE, HASH = "git-tracked", "sha256"
#: What of an index keeps it from being brought up to date, in words.
BLOCKERS = {
    "schema_version": "its tables have another layout", "file_source": "its files were found in another way", "hash_algorithm": "its contents were hashed in another way", "fts5": "it was made with another full-text setting",
    "config_max_bytes": "it was made with another limit of file sizes", "config_ignore_dirs": "it was made with other ignored folders", "config_encoding_fallbacks": "it was made with other fallback encodings",
    "different_checkout": "it is of another checkout", "unknown_git_history": "its revision isn't in this repository",
}
ADOPTABLE = {"different_checkout", "unknown_git_history"}


class Incompatible(ValueError):
    def __init__(self, blocker: str):
        super().__init__(f"the index can't be updated: {BLOCKERS[blocker]}; rebuild it" + (" or adopt it with update" if blocker in ADOPTABLE else ""))
        self.blocker = blocker


def settings(config: Config) -> dict[str, str]:
    return {"schema_version": SCHEMA_VERSION, "file_source": FILE_SOURCE, "hash_algorithm": HASH, "fts5": "1", "config_max_bytes": str(config.max_bytes), "config_ignore_dirs": json.dumps(sorted(config.ignore_dirs)),
            "config_encoding_fallbacks": json.dumps(config.fallbacks)}


def blocker(meta: dict[str, str], root: Path, config: Config) -> str | None:
    """What keeps an index from being brought up to date, in a fixed order; a value that isn't stored blocks nothing."""
    for key, value in settings(config).items():
        if meta.get(key) and meta[key] != value:
            return key
    if meta.get("root") and meta["root"] != str(root):
        return "different_checkout"
    head = meta.get("vcs_head") or meta.get("vcs_revision")
    return "unknown_git_history" if head and not git.commit_exists(root, head) else None


def derive(scanned: DataFrame) -> dict[str, DataFrame]:
    """The four tables of scanned files that have ids: files (id, ...), lines, symbols without ids, file_metrics."""
    whole = scanned.where("index_status = 'indexed'").withColumn("lines", split_lines(F.col("text"))).withColumnRenamed("id", "file_id")
    own = F.col("language").isin("go", "ruby")
    symbols = pattern_symbols(whole.where(F.coalesce(~own, F.lit(True)))).unionByName(scanned_symbols(whole.where(own)))
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
    metrics = with_metrics(whole).join(counts, "file_id", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
    lines = whole.select("file_id", F.posexplode("lines").alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line"), F.regexp_replace("text", "\x00", "").alias("text"))
    return {"files": scanned.select(*(f.name for f in SCHEMAS["files"].fields)), "lines": lines, "symbols": symbols, "file_metrics": metrics.select(*(f.name for f in SCHEMAS["file_metrics"].fields))}


def with_postings(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables and their full-text index."""
    return tables | {"symbols_postings": symbol_postings(tables["symbols"]), "files_postings": file_postings(tables["files"], tables["lines"])}


def next_tables(x: Index, fresh: dict[str, DataFrame], outcomes: DataFrame) -> dict[str, DataFrame]:
    """The tables of the next snapshot: the rows of untouched files, and the fresh ones."""
    stale = x.files.join(outcomes.where("outcome <> 'unchanged' or removed").select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    gone = x.symbols.join(stale, "file_id", "left_semi").select(F.col("id").alias("key"))
    added = with_postings(fresh)
    return {"files": next_rows(x.files, fresh["files"], outcomes), "symbols": next_rows(x.symbols, fresh["symbols"], outcomes), "file_metrics": next_rows(x.metrics, fresh["file_metrics"], outcomes),
            "lines": x.lines.join(stale, "file_id", "left_anti").unionByName(fresh["lines"]), "symbols_postings": x.symbols_postings.join(gone, "key", "left_anti").unionByName(added["symbols_postings"]),
            "files_postings": x.files_postings.join(stale.withColumnRenamed("file_id", "key"), "key", "left_anti").unionByName(added["files_postings"])}


def metadata(spark: SparkSession, old: dict[str, str], operation: str, root: Path, config: Config) -> DataFrame:
    """Metadata after an operation. Values that aren't known now leave the stored ones."""
    fresh = settings(config) | {"root": str(root), "updated_at": now(), "last_operation": operation} | git.state(root)
    if operation != "update":
        fresh["indexed_at"] = fresh["updated_at"]
    return spark.createDataFrame(sorted((old | {k: v for k, v in fresh.items() if v}).items()), SCHEMAS["meta"])


def parts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The state of each component: ready if the snapshot to be written has its tables."""
    needs = {"files": ["files"], "lines": ["lines"], "symbols": ["symbols"], "metrics": ["file_metrics"], "fts": POSTINGS}
    return spark.createDataFrame([(n, "ready" if all(t in tables for t in ts) else "unavailable", now()) for n, ts in needs.items()], SCHEMAS["components"])


def with_parts(spark: SparkSession, tables: dict[str, DataFrame], meta: DataFrame) -> dict[str, DataFrame]:
    return tables | {"meta": meta, "components": parts(spark, tables)}


@dataclass
class Result:
    operation: str
    counts: dict[str, int] = field(default_factory=dict)
    skipped: bool = False


def init(spark: SparkSession, store: Store, root: Path, config: Config) -> Result:
    if store.current() is not None:
        raise FileExistsError(f"there is an index at {store.folder}")
    if not store.lock("init", str(root)):
        raise BlockingIOError("the index is locked")
    try:
        tables = {n: empty(spark, n) for n in ("files", "lines", "symbols", "file_metrics", *POSTINGS)}
        store.publish(with_parts(spark, tables, metadata(spark, {}, "init", root, config)))
    finally:
        store.unlock()
    return Result("init", {"files": 0})


def rebuild(spark: SparkSession, store: Store, root: Path, config: Config) -> Result:
    def work() -> Result:
        scanned = with_ids(git.scan(spark, root, config), ["path"]).persist()
        t = derive(scanned)
        t["symbols"] = with_ids(t["symbols"], ["path", "line", "column", "kind", "name"])
        store.publish(with_parts(spark, with_postings(t), metadata(spark, {}, "rebuild", root, config)))
        x = store.read(spark)
        m = x.metrics.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("line_count", "code_lines", "comment_lines", "blank_lines", "symbol_count"))).first()
        f = x.files.agg(F.count_if(F.col("index_status") == "skipped").alias("skipped"), F.coalesce(F.sum("transcoded"), F.lit(0)).alias("transcoded")).first()
        scanned.unpersist()
        return Result("rebuild", {"files": m["n"], "symbols": m["symbol_count"], "lines": m["line_count"], "code_lines": m["code_lines"], "comment_lines": m["comment_lines"], "blank_lines": m["blank_lines"],
                                  "transcoded": f["transcoded"], "skipped": f["skipped"]})

    out = store.recorded(spark, "rebuild", str(root), work)
    return out or Result("rebuild", skipped=True)


def update(spark: SparkSession, store: Store, root: Path, config: Config, adopt: bool = False) -> Result:
    if store.current() is None:
        raise FileNotFoundError(f"no index at {store.folder}; run rebuild")

    def work() -> Result:
        x = store.read(spark)
        meta = {r["key"]: r["value"] for r in x.meta.collect()}
        b = blocker(meta, root, config)
        if b and not (adopt and b in ADOPTABLE):
            raise Incompatible(b)
        none = x.files.limit(1).count() == 0
        only = None if none else git.changed(root, meta.get("vcs_revision"), meta.get("vcs_dirty") != "0")
        scanned = git.scan(spark, root, config, only).persist()
        candidates = None if only is None else spark.createDataFrame([(p,) for p in sorted(only)], "path string")
        outcomes = reconcile(x.files, scanned, candidates).persist()
        counts = update_counts(outcomes).first().asDict()
        changed = scanned.join(outcomes.where("outcome <> 'unchanged' and now is not null").select("path"), "path", "left_semi")
        top = x.files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = derive(with_ids(changed, ["path"], start=top).persist())
        first = x.symbols.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh["symbols"] = with_ids(fresh["symbols"], ["path", "line", "column", "kind", "name"], start=first)
        counts["symbols"] = fresh["symbols"].count()
        store.publish(with_parts(spark, next_tables(x, fresh, outcomes), metadata(spark, meta, "update", root, config)))
        scanned.unpersist()
        return Result("update", counts)

    out = store.recorded(spark, "update", str(root), work)
    return out or Result("update", skipped=True)


def freshness(meta: dict[str, str], root: Path) -> str:
    """fresh, stale or unknown: whether the index still says what is in the checkout."""
    s = git.state(root)
    if not s.get("vcs_head") or "vcs_dirty" not in s or not meta.get("vcs_head"):
        return "unknown"
    if s["vcs_head"] != meta["vcs_head"]:
        return "stale"
    if s["vcs_dirty"] == "0":
        return "fresh" if meta.get("vcs_dirty") == "0" else "stale"
    if meta.get("vcs_dirty") != "1":
        return "stale"
    return "unknown" if not meta.get("vcs_dirty_hash") else ("fresh" if meta["vcs_dirty_hash"] == s["vcs_dirty_hash"] else "stale")
