"""The navigation queries: each is one plan over the tables of a snapshot.

Where the order of ties is left open elsewhere, a total order is defined here: further columns follow, so a limit always keeps the same rows. A
negative limit means none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_nocase, equals_nocase, identifier, like_nocase, normalized_path
from ..sources.tables import Index

SYMBOL_COLUMNS = ["path", "line", "kind", "name", "language", "signature"]
FILE_LIST_COLUMNS = ["path", "language", "extension", "size", "index_status", "source_encoding", "transcoded", "skip_reason"]
#: Kinds of symbols that enclose code.
SCOPE_KINDS = ["class", "enum", "function", "interface", "method", "module", "trait", "type"]
COMPONENT_ORDER = ["files", "lines", "symbols", "metrics", "fts"]
STATS_META_HEAD = ["root", "schema_version", "file_source", "indexed_at", "updated_at", "last_operation", "vcs_kind", "vcs_revision", "vcs_ref", "vcs_head", "vcs_branch", "vcs_dirty"]
STATS_META_TAIL = ["hash_algorithm", "fts5"]


def limited(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None or n < 0 else df.limit(n)


def _filtered(df: DataFrame, kind: str | None, language: str | None) -> DataFrame:
    if kind:
        df = df.where(F.col("kind") == kind)
    return df.where(F.col("language") == language) if language else df


def defs(index: Index, query: str, kind: str | None = None, language: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose name equals the query or starts with it, or whose signature or path contains it, without regard to ASCII case: exact names first, then
    prefixes, then the rest."""
    exact, prefix = equals_nocase(F.col("name"), query), like_nocase(F.col("name"), f"{query}%")
    hit = _filtered(index.symbols.where(exact | prefix | contains_nocase(F.col("signature"), query) | contains_nocase(F.col("path"), query)), kind, language)
    rank = F.when(exact, 0).when(prefix, 1).otherwise(2)
    return limited(hit.orderBy(rank, "path", "line", "column", "name", "kind", "id"), limit).select(*SYMBOL_COLUMNS)


def defs_list(index: Index, kind: str | None = None, language: str | None = None, limit: int = 50) -> DataFrame:
    return limited(_filtered(index.symbols, kind, language).orderBy("path", "line", "column", "name", "kind", "id"), limit).select(*SYMBOL_COLUMNS)


def target(files: DataFrame, path: str, slash: bool) -> DataFrame:
    """The one file that a path stands for: that path, else the shortest that ends with it. An outline wants a / before the ending, a window of lines
    doesn't."""
    p = normalized_path(path)
    hit = files.where((F.col("path") == p) | like_nocase(F.col("path"), f"%/{p}" if slash else f"%{p}"))
    return hit.orderBy(F.when(F.col("path") == p, 0).otherwise(1), F.length("path"), "path", "id").limit(1).select(F.col("id").alias("target_id"))


def outline(index: Index, path: str) -> DataFrame:
    # one row by construction; a semi join goes below the removal of repeats, so that only the rows of the file move
    at = F.broadcast(target(index.files, path, slash=True))
    return index.symbols.join(at, F.col("file_id") == F.col("target_id"), "left_semi").orderBy("line", "column", "name", "kind", "id").select(*SYMBOL_COLUMNS)


def show(index: Index, path: str, line: int, context: int = 3) -> DataFrame:
    if line <= 0:
        raise ValueError("line must be greater than 0")
    near = index.lines.where(F.col("line").between(max(1, line - context), line + context))
    at = F.broadcast(target(index.files, path, slash=False))
    return near.join(at, F.col("file_id") == F.col("target_id"), "left_semi").orderBy("line").select("line", "text")


def files(index: Index, query: str | None = None, status: str = "indexed", language: str | None = None, limit: int = 100) -> DataFrame:
    if status not in ("indexed", "skipped", "all"):
        raise ValueError(f"unknown status {status!r}: indexed, skipped or all")
    df = index.files if query is None else index.files.where(contains_nocase(F.col("path"), query))
    df = df if status == "all" else df.where(F.col("index_status") == status)
    df = df.where(F.col("language") == language) if language else df
    return limited(df.orderBy("path", "id"), limit).select(*FILE_LIST_COLUMNS)


def metrics_summary(index: Index, language: str | None = None, limit: int = 100) -> DataFrame:
    """Files and lines per language. The filter looks at the language itself, so that files without one can't be chosen."""
    df = index.metrics.where(F.col("language") == language) if language else index.metrics
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    out = df.groupBy(F.coalesce("language", F.lit("(unknown)")).alias("language")).agg(
        F.count(F.lit(1)).alias("files"), total("line_count", "lines"), total("code_lines", "code"), total("comment_lines", "comments"), total("blank_lines", "blank"), total("symbol_count", "symbols"))
    return limited(out.orderBy(F.desc("lines"), "language"), limit)


def metrics_files(index: Index, query: str, language: str | None = None, limit: int = 100) -> DataFrame:
    df = index.metrics.where(contains_nocase(F.col("path"), query))
    df = df.where(F.col("language") == language) if language else df
    out = df.select("path", F.coalesce("language", F.lit("(unknown)")).alias("language"), F.col("line_count").alias("lines"), F.col("code_lines").alias("code"), F.col("comment_lines").alias("comments"),
                    F.col("blank_lines").alias("blank"), F.col("symbol_count").alias("symbols"))
    return limited(out.orderBy(F.desc("lines"), "path"), limit)


def definitions(index: Index, name: str, language: str | None = None, ignore_case: bool = False) -> DataFrame:
    hit = index.symbols.where(equals_nocase(F.col("name"), name) if ignore_case else F.col("name") == name)
    return hit.where(F.col("language") == language) if language else hit


def refs_definitions(index: Index, name: str, kinds: list[str] | None = None, language: str | None = None, ignore_case: bool = False) -> DataFrame:
    hit = definitions(index, name, language, ignore_case)
    hit = hit.where(F.col("kind").isin(*sorted(set(kinds)))) if kinds else hit
    return hit.orderBy("path", "line", "column", "name", "kind", "id").select(*SYMBOL_COLUMNS)


def refs_candidates(index: Index, name: str, language: str | None = None, ignore_case: bool = False, limit: int = 100) -> DataFrame:
    """Lines in which the name stands as a whole identifier, without those that define it (whatever kinds were asked for). The limit counts after both."""
    if not name or limit <= 0:
        raise ValueError("refs needs a name, and a limit greater than 0")
    hit = index.lines.where(identifier(F.col("text"), name, ignore_case))
    at = index.files.select(F.col("id").alias("file_id"), "path", "language")
    at = at.where(F.col("language") == language) if language else at
    found = hit.join(at, "file_id").join(definitions(index, name, language, ignore_case).select("path", "line").distinct(), ["path", "line"], "left_anti")
    return found.orderBy("path", "line", "file_id").limit(limit).select("path", "line", "language", "text")


def refs(index: Index, name: str, language: str | None = None, ignore_case: bool = False, limit: int = 100) -> DataFrame:
    """The candidates with the scopes around each, outermost first: symbols of several lines whose lines contain the candidate's."""
    found = refs_candidates(index, name, language, ignore_case, limit)
    scopes = index.symbols.where(F.col("kind").isin(*SCOPE_KINDS) & (F.col("end_line") > F.col("line"))).select("path", F.col("line").alias("l"), "end_line", "column", "name", "kind")
    # only where the candidates stand moves, not their text
    inside = scopes.join(found.select("path", "line").distinct(), "path").where(F.col("line").between(F.col("l"), F.col("end_line")))
    of = inside.groupBy("path", "line").agg(F.array_sort(F.collect_set(F.struct(F.col("l"), (-F.col("end_line")).alias("e"), "column", "name", "kind"))).alias("s"))
    scope = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["l"].alias("line")))
    empty = F.array().cast("array<struct<kind:string,name:string,line:int>>")
    return found.join(of, ["path", "line"], "left").orderBy("path", "line").select("path", "line", "language", "text", F.coalesce(scope, empty).alias("scopes"))


def counts(index: Index) -> DataFrame:
    """One row: files, skipped_files, symbols, lines, code_lines, comment_lines, blank_lines. Each table is read once."""
    of_files = index.files.agg(F.count_if(F.col("index_status") == "indexed").alias("files"), F.count_if(F.col("index_status") == "skipped").alias("skipped_files"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    of_metrics = index.metrics.agg(total("code_lines"), total("comment_lines"), total("blank_lines"))
    one = of_files.withColumn("one", F.lit(1))
    for df in (index.symbols.agg(F.count(F.lit(1)).alias("symbols")), (index.lines if index.line_keys is None else index.line_keys).agg(F.count(F.lit(1)).alias("lines")), of_metrics):
        one = one.join(df.withColumn("one", F.lit(1)), "one")  # of one row each
    return one.select("files", "skipped_files", "symbols", "lines", "code_lines", "comment_lines", "blank_lines")


def stats(index: Index) -> DataFrame:
    """(key, value) of the metadata and counts, all as text, in a fixed order; metadata that isn't there gives no row."""
    names = ["files", "skipped_files", "symbols", "lines", "code_lines", "comment_lines", "blank_lines"]
    pairs = F.explode(F.array(*(F.struct(F.lit(100 + i).alias("o"), F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)))).alias("x")
    rows = counts(index).select(pairs).select("x.*")
    if index.meta is not None:
        place = {k: i for i, k in enumerate(STATS_META_HEAD)} | {k: 200 + i for i, k in enumerate(STATS_META_TAIL)}
        order = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
        rows = rows.unionByName(index.meta.where(F.col("key").isin(*place)).select(order[F.col("key")].alias("o"), "key", "value"))
    return rows.orderBy("o").select("key", "value")


def components(index: Index) -> DataFrame:
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, c in enumerate(COMPONENT_ORDER, 1) for x in (c, i)))[F.col("name")], F.lit(100))
    return index.components.orderBy(rank, "name").select("name", "status", "updated_at")


def logs(index: Index, limit: int = 20) -> DataFrame:
    if limit <= 0:
        raise ValueError("limit must be greater than 0")
    return index.runs.orderBy(F.desc("id")).limit(limit).select("id", "operation", "status", "root", "db", "started_at", "finished_at", F.col("error_message").alias("error"))


def retained_runs(runs: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest runs that stay in the log."""
    return runs.orderBy(F.desc("id")).limit(keep)


def without_symbols(index: Index) -> DataFrame:
    """Indexed files that define nothing."""
    return index.files.where(F.col("index_status") == "indexed").join(index.symbols.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti").select("id", "path", "language")


def same_content(files: DataFrame) -> DataFrame:
    """content_hash, copies, first_path of contents that several files have."""
    return files.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def large_with_few_symbols(index: Index, least_lines: int, most_symbols: int, limit: int) -> DataFrame:
    hit = index.metrics.where((F.col("line_count") >= least_lines) & (F.col("symbol_count") <= most_symbols))
    return limited(hit.orderBy(F.desc("line_count"), "path"), limit).select("path", "language", "line_count", "symbol_count")

