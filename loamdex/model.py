"""The relational model: the schema of each table, its key, and the registry the catalog queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = "4"

_L, _I, _S = LongType(), IntegerType(), StringType()


def _table(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, null) for n, t, null in fields])


SCHEMAS: dict[str, StructType] = {
    "meta": _table(("key", _S, False), ("value", _S, False)),
    "components": _table(("name", _S, False), ("status", _S, False), ("updated_at", _S, False)),
    "files": _table(("id", _L, False), ("path", _S, False), ("language", _S, True), ("extension", _S, True), ("size", _L, False), ("mtime", _L, False), ("content_hash", _S, False),
                    ("index_status", _S, False), ("source_encoding", _S, True), ("encoding_source", _S, True), ("transcoded", _I, False), ("skip_reason", _S, True)),
    "symbols": _table(("id", _L, False), ("file_id", _L, False), ("path", _S, False), ("language", _S, True), ("kind", _S, False), ("name", _S, False), ("line", _I, False), ("end_line", _I, False),
                      ("column", _I, False), ("signature", _S, False), ("context", _S, False)),
    "lines": _table(("file_id", _L, False), ("line", _I, False), ("text", _S, False)),
    "file_metrics": _table(("file_id", _L, False), ("path", _S, False), ("language", _S, True), ("line_count", _I, False), ("blank_lines", _I, False), ("comment_lines", _I, False),
                           ("code_lines", _I, False), ("symbol_count", _I, False)),
    "files_fts": _table(("path", _S, True), ("language", _S, True), ("content", _S, True)),
    "symbols_fts": _table(("name", _S, True), ("kind", _S, True), ("language", _S, True), ("path", _S, True), ("signature", _S, True), ("context", _S, True)),
    "build_runs": _table(("id", _L, False), ("operation", _S, False), ("status", _S, False), ("root", _S, False), ("db", _S, False), ("started_at", _S, False), ("finished_at", _S, False), ("error_message", _S, True)),
}
#: A posting of the full-text index: what is found, its field, the token's place in the field, and the token.
POSTING = _table(("key", _L, False), ("column", _S, False), ("position", _L, False), ("token", _S, False))
POSTINGS = ["symbols_postings", "files_postings"]


def schema_of(name: str) -> StructType:
    return POSTING if name in POSTINGS else SCHEMAS[name]


KEYS: dict[str, list[str]] = {"meta": ["key"], "components": ["name"], "files": ["id"], "symbols": ["id"], "lines": ["file_id", "line"], "file_metrics": ["file_id"], "files_fts": [], "symbols_fts": [], "build_runs": ["id"]}
STATUSES = {"components.status": ("ready", "disabled", "unavailable"), "files.index_status": ("indexed", "skipped"), "files.encoding_source": ("utf8", "bom", "declaration", "fallback"),
            "build_runs.status": ("succeeded", "failed", "skipped")}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def catalog_rows(names: list[str] | None = None) -> list[tuple[str, int, str, str, bool, int | None]]:
    """(table, ordinal, column, type, nullable, place in the key) of each column, the way a store of integers and texts declares them. A part of a key is
    never nullable; full-text columns have no type."""
    out = []
    for t in sorted(names or [n for n in SCHEMAS if n != "build_runs"]):
        for i, f in enumerate(SCHEMAS[t].fields, 1):
            place = KEYS[t].index(f.name) + 1 if f.name in KEYS[t] else None
            kind = "-" if t.endswith("_fts") else ("INTEGER" if f.dataType in (_L, _I) else "TEXT")
            out.append((t, i, f.name, kind, f.nullable and place is None, place))
    return out


def checked(df: DataFrame, name: str) -> DataFrame:
    """df in the table's columns and types; an unknown value of an enumerated column fails the write."""
    from pyspark.sql import functions as F

    out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(name).fields))
    for column, allowed in STATUSES.items():
        t, c = column.split(".")
        if t == name:
            bad = F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
            out = out.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(c)))).otherwise(F.col(c)))
    return out
