"""Snapshots: every build writes a new folder of Parquet tables, and one pointer names the current one."""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import POSTINGS, SCHEMAS, checked, empty, schema_of
from ..operators.navigate import retained_runs
from .tables import Index

TABLES = ["files", "lines", "symbols", "file_metrics", "meta", "components", *POSTINGS]
KEPT = 2  # snapshots that stay, so that a reader of the last one can finish


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Store:
    """An index on a file system: ``v=N`` folders, ``CURRENT``, a lock and the log of runs beside them."""

    def __init__(self, folder: Path):
        self.folder = Path(folder)

    def current(self) -> Path | None:
        try:
            return self.folder / (self.folder / "CURRENT").read_text().strip()
        except OSError:
            return None

    def publish(self, tables: dict[str, DataFrame]) -> Path:
        """Writes a snapshot and makes it the current one. A reader sees the old one or the new one, never a mixture; a failed write leaves the old."""
        last = self.current()
        n = int(last.name.split("=")[1]) + 1 if last else 1
        new = self.folder / f"v={n}"
        shutil.rmtree(new, ignore_errors=True)
        for name in TABLES:
            df = checked(tables[name], name)
            if name in POSTINGS:
                # a search reads the row groups of its tokens alone
                df.repartitionByRange("token").sortWithinPartitions("token", "key").write.mode("overwrite").parquet(str(new / f"{name}.parquet"))
                continue
            order = {"files": ["path"], "symbols": ["name"], "lines": ["file_id", "line"], "file_metrics": ["path"]}.get(name)
            (df.sortWithinPartitions(*order) if order else df.coalesce(1)).write.mode("overwrite").parquet(str(new / f"{name}.parquet"))
        tmp = self.folder / "CURRENT.tmp"
        tmp.write_text(new.name)
        os.replace(tmp, self.folder / "CURRENT")
        for old in self.folder.glob("v=*"):
            if int(old.name.split("=")[1]) <= n - KEPT:
                shutil.rmtree(old, ignore_errors=True)
        return new

    def read(self, spark: SparkSession) -> Index:
        at = self.current()
        if at is None:
            raise FileNotFoundError(f"no index at {self.folder}")
        t = {n: spark.read.schema(schema_of(n)).parquet(str(at / f"{n}.parquet")) for n in TABLES}
        return Index(t["files"], t["lines"], t["symbols"], t["file_metrics"], self.runs(spark), t["meta"], t["components"], *(t[n] for n in POSTINGS))

    def tables(self) -> list[str]:
        """The tables that the current snapshot has; the full-text ones tell whether it can be searched."""
        at = self.current()
        return [n for n in TABLES if at and (at / f"{n}.parquet").is_dir()]

    def meta(self, spark: SparkSession) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read(spark).meta.collect()}

    # ------------------------------------------------------------------------------------------------------ log of runs

    def runs(self, spark: SparkSession) -> DataFrame:
        at = self.folder / "runs"
        return spark.read.schema(SCHEMAS["build_runs"]).parquet(str(at)) if at.is_dir() and any(at.glob("*.parquet")) else empty(spark, "build_runs")

    def record(self, spark: SparkSession, operation: str, status: str, root: str, started: str, error: str | None = None, keep: int = 1000) -> None:
        """Appends a run and keeps the newest."""
        old = self.runs(spark)
        last = old.agg({"id": "max"}).first()[0] or 0
        row = spark.createDataFrame([(last + 1, operation, status, root, str(self.folder), started, datetime.now(timezone.utc).isoformat().replace("+00:00", "Z"), error)], SCHEMAS["build_runs"])
        new = self.folder / "runs.new"
        retained_runs(old.unionByName(row), keep).coalesce(1).write.mode("overwrite").parquet(str(new))
        shutil.rmtree(self.folder / "runs", ignore_errors=True)
        os.replace(new, self.folder / "runs")

    # ------------------------------------------------------------------------------------------------------------ lock

    def lock(self, operation: str, root: str) -> bool:
        """Takes the lock, also from a process that is gone; False if another holds it."""
        self.folder.mkdir(parents=True, exist_ok=True)
        at = self.folder / "LOCK"
        for _ in range(2):
            try:
                fd = os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if self.lock_holder() is not None:
                    return False
                at.unlink(missing_ok=True)
                continue
            with os.fdopen(fd, "w") as f:
                json.dump({"pid": os.getpid(), "operation": operation, "root": root, "started_at": now()}, f)
            return True
        return False

    def lock_holder(self) -> dict | None:
        """Who holds the lock; null if nobody does who still runs."""
        try:
            held = json.loads((self.folder / "LOCK").read_text())
            os.kill(int(held["pid"]), 0)
        except (OSError, ValueError, KeyError, TypeError) as e:
            return held if isinstance(e, PermissionError) else None
        return held

    def unlock(self) -> None:
        (self.folder / "LOCK").unlink(missing_ok=True)

    def recorded(self, spark: SparkSession, operation: str, root: str, work: Callable[[], object]) -> object | None:
        """Runs work under the lock and records how it ended; null if another process holds the lock."""
        started = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
        if not self.lock(operation, root):
            self._log(spark, operation, "skipped", root, started, None)
            return None
        try:
            out = work()
        except Exception as e:
            self._log(spark, operation, "failed", root, started, str(e).split("\n")[0][:500])
            raise
        finally:
            self.unlock()
        self._log(spark, operation, "succeeded", root, started, None)
        return out

    def _log(self, spark: SparkSession, operation: str, status: str, root: str, started: str, error: str | None) -> None:
        try:
            self.record(spark, operation, status, root, started, error)
        except Exception as e:  # a lost log line is no failure of the run
            print(f"warning: the run could not be recorded: {e}")
