"""The registered queries of the engine over the tables of a folder, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as line_metrics
from .functions import text as T
from .operators import fulltext, incremental, navigate
from .operators.scanners import scanned_symbols
from .operators.symbols import SPECS, line_symbols
from .plans import sqlgate
from .sources.tables import Index, newest_files, read_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What several of the SQL queries start with: the tables without repeats and outdated rows.
CLEAN = """with f as (select id, path, language, extension, size, mtime, content_hash, index_status, source_encoding, encoding_source, transcoded, skip_reason
  from (select *, row_number() over (partition by id order by mtime desc, language desc) as rn from (select distinct * from files)) where rn = 1),
l as (select distinct file_id, line, text from file_lines), s as (select distinct * from symbols), m as (select distinct * from file_metrics), r as (select distinct * from build_runs)
"""
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold(x: str) -> str:
    return FOLD.format(x)


def query(sql: str | None = None) -> Callable[[Callable[[Index], DataFrame]], Callable[[Index], DataFrame]]:
    """Registers a query over the cleaned tables, with its SQL."""

    def add(f: Callable[[Index], DataFrame]) -> Callable[[Index], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(read_index(spark, d))
        if sql:
            SQL[f.__name__] = CLEAN + sql
        return f

    return add


SUMMARY = "select coalesce(language, '(unknown)') as language, count(*) as files, cast(sum(line_count) as bigint) as lines, cast(sum(code_lines) as bigint) as code, cast(sum(comment_lines) as bigint) as comments, cast(sum(blank_lines) as bigint) as blank, cast(sum(symbol_count) as bigint) as symbols from m {} group by 1"


@query(SUMMARY.format(""))
def metrics_summary(x: Index) -> DataFrame:
    return navigate.metrics_summary(x)


@query(SUMMARY.format("where language = 'python'"))
def metrics_summary_language(x: Index) -> DataFrame:
    return navigate.metrics_summary(x, language="python")


@query("select path, coalesce(language, '(unknown)') as language, line_count as lines, code_lines as code, comment_lines as comments, blank_lines as blank, symbol_count as symbols from m "
       f"where {fold('path')} like '%core/%' order by lines desc, path limit 100")
def metrics_files(x: Index) -> DataFrame:
    return navigate.metrics_files(x, "Core/")


LISTED = "path, language, extension, size, index_status, source_encoding, transcoded, skip_reason"


@query(f"select {LISTED} from f where index_status = 'indexed' order by path, id limit 100")
def files_list(x: Index) -> DataFrame:
    return navigate.files(x)


@query(f"select {LISTED} from f where index_status = 'indexed' and {fold('path')} like '%harbor%'")
def files_search_nocase(x: Index) -> DataFrame:
    return navigate.files(x, "HARBOR", limit=-1)


@query(f"select {LISTED} from f where index_status = 'skipped'")
def files_status_skipped(x: Index) -> DataFrame:
    return navigate.files(x, status="skipped", limit=-1)


@query(f"select {LISTED} from f")
def files_status_all(x: Index) -> DataFrame:
    return navigate.files(x, status="all", limit=-1)


@query(f"select {LISTED} from f where index_status = 'indexed' and language = 'go' and {fold('path')} like '%\\_1%' escape '~'".replace("\\_", "_"))
def files_like_wildcard(x: Index) -> DataFrame:
    """An underscore of the user stands for any character."""
    return navigate.files(x, "_1", language="go", limit=-1)


@query("select file_id, count(*) as n_lines, cast(sum(length(text)) as bigint) as n_chars from l group by 1")
def lines_per_file(x: Index) -> DataFrame:
    return x.lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


DEFS = f"""select path, line, kind, name, language, signature from s where ({fold('name')} = 'load' or {fold('name')} like 'load%' escape '~' or {fold('signature')} like '%load%' or {fold('path')} like '%load%') {{}}
order by case when {fold('name')} = 'load' then 0 when {fold('name')} like 'load%' then 1 else 2 end, path, line, "column", name, kind, id limit {{}}"""


@query(DEFS.format("", 50))
def defs_ranked(x: Index) -> DataFrame:
    return navigate.defs(x, "LOAD")


@query(DEFS.format("and kind = 'method' and language = 'java'", 20))
def defs_kind_language(x: Index) -> DataFrame:
    return navigate.defs(x, "load", kind="method", language="java", limit=20)


@query('select path, line, kind, name, language, signature from s where kind = \'class\' order by path, line, "column", name, kind, id limit 50')
def defs_list(x: Index) -> DataFrame:
    return navigate.defs_list(x, kind="class")


@query(f"select path, line, kind, name, language, signature from s where {fold('name')} = 'rank_f' or {fold('name')} like 'rank_f%' or {fold('signature')} like '%rank_f%' or {fold('path')} like '%rank_f%'")
def defs_like_wildcard(x: Index) -> DataFrame:
    return navigate.defs(x, "rank_f", limit=-1)


TARGET = "t as (select id from f where path = '{0}' or " + fold("path") + " like '{1}{0}' order by case when path = '{0}' then 0 else 1 end, length(path), path, id limit 1)"


@query(", " + TARGET.format("frame.js", "%/") + " select s.path, line, kind, name, s.language, signature from s join t on s.file_id = t.id")
def outline_target(x: Index) -> DataFrame:
    return navigate.outline(x, "frame.js")


@query(", " + TARGET.format("ame.js", "%") + " select line, text from l join t on l.file_id = t.id where line between 2 and 8")
def show_context(x: Index) -> DataFrame:
    """A window's path may end within a name."""
    return navigate.show(x, "ame.js", 5)


DEFINED = "name = (select name from s group by 1 order by count(*) desc, name limit 1)"


@query(f"select path, line, kind, name, language, signature from s where {DEFINED}")
def refs_definitions(x: Index) -> DataFrame:
    """The definitions of the name that has most of them."""
    most = x.symbols.groupBy("name").count().orderBy(F.desc("count"), "name").first()
    return navigate.refs_definitions(x, most["name"] if most else "none")


@query("select path, line, kind, name, language, signature from s where lower(name) = (select lower(name) from s where kind = 'class' and language = 'python' group by 1 order by count(*) desc, 1 limit 1) and kind in ('class', 'method')")
def refs_definitions_kinds(x: Index) -> DataFrame:
    most = x.symbols.where("kind = 'class' and language = 'python'").groupBy(F.lower("name").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return navigate.refs_definitions(x, most["n"].upper() if most else "none", kinds=["method", "class"], ignore_case=True)


ID = r"(^|[^_$\pL\p{{Nd}}]){}($|[^_$\pL\p{{Nd}}])"
CANDIDATES = """, d as (select distinct path, line from s where {0}), c as (select f.path, l.line, f.language, l.text, l.file_id from l join f on f.id = l.file_id where regexp_matches(l.text, '{1}', '{2}') {3})
select c.path, c.line, c.language, c.text from c where not exists (select 1 from d where d.path = c.path and d.line = c.line) order by c.path, c.line, c.file_id limit {4}"""


@query(CANDIDATES.format("name = 'harbor'", ID.format("harbor"), "c", "", 100))
def refs_candidates(x: Index) -> DataFrame:
    return navigate.refs_candidates(x, "harbor")


@query(CANDIDATES.format(f"{fold('name')} = 'saddle'", ID.format("saddle"), "i", "", 200))
def refs_ignore_case(x: Index) -> DataFrame:
    return navigate.refs_candidates(x, "SADDLE", ignore_case=True, limit=200)


@query(CANDIDATES.format("name = 'ledger' and language = 'python'", ID.format("ledger"), "c", "and f.language = 'python'", 50))
def refs_language(x: Index) -> DataFrame:
    return navigate.refs_candidates(x, "ledger", language="python", limit=50)


@query(CANDIDATES.format("name = 'canal'", ID.format("canal"), "c", "", 100000).replace("select c.path, c.line, c.language, c.text from c where", """, k as (select c.* from c where""")
       + """) select k.path, k.line, z.kind as scope_kind, z.name as scope_name, z.line as scope_line from k join s z on z.path = k.path and z.line <= k.line and z.end_line >= k.line
where z.end_line > z.line and z.kind in ('class', 'enum', 'function', 'interface', 'method', 'module', 'trait', 'type')""")
def refs_scopes(x: Index) -> DataFrame:
    """Each candidate's enclosing scopes, as rows."""
    found = navigate.refs(x, "canal", limit=100_000)
    return found.select("path", "line", F.explode("scopes").alias("z")).select("path", "line", F.col("z.kind").alias("scope_kind"), F.col("z.name").alias("scope_name"), F.col("z.line").alias("scope_line"))


COUNTS = [("files", "count(*) from f where index_status = 'indexed'"), ("skipped_files", "count(*) from f where index_status = 'skipped'"), ("symbols", "count(*) from s"), ("lines", "count(*) from l"),
          ("code_lines", "coalesce(sum(code_lines), 0) from m"), ("comment_lines", "coalesce(sum(comment_lines), 0) from m"), ("blank_lines", "coalesce(sum(blank_lines), 0) from m")]
META = [("schema_version", "4"), ("root", "/srv/checkouts"), ("hash_algorithm", "sha256"), ("fts5", "1"), ("other", "x")]


@query(" union all ".join(f"select '{k}' as key, '{v}' as value" for k, v in META if k != "other") + " union all " + " union all ".join(f"select '{k}', cast((select {q.replace(' from', ' from', 1)}) as varchar)" for k, q in COUNTS))
def stats_kv_union(x: Index) -> DataFrame:
    x.meta = x.files.sparkSession.createDataFrame(META, "key string, value string")
    return navigate.stats(x)


@query("select " + ", ".join(f"cast((select {q}) as bigint) as {k}" for k, q in COUNTS))
def stats_one_row(x: Index) -> DataFrame:
    return navigate.counts(x)


PARTS = [("fts", "unavailable"), ("metrics", "ready"), ("files", "ready"), ("extra", "ready"), ("symbols", "ready"), ("lines", "ready")]


@query("select * from (values " + ", ".join(f"('{a}', '{b}', '2022-01-01T00:00:00Z')" for a, b in PARTS) + ") v(name, status, updated_at)")
def components_ranked(x: Index) -> DataFrame:
    x.components = x.files.sparkSession.createDataFrame([(a, b, "2022-01-01T00:00:00Z") for a, b in PARTS], "name string, status string, updated_at string")
    return navigate.components(x)


@query("select id, operation, status, root, db, started_at, finished_at, error_message as error from r order by id desc limit 20")
def logs_newest(x: Index) -> DataFrame:
    return navigate.logs(x)


@query("select * from r order by id desc limit 15")
def logs_retention(x: Index) -> DataFrame:
    """Fewer runs than the smallest table has, so that some have to go."""
    return navigate.retained_runs(x.runs, keep=15)


@query("select id, operation, status from r where id not in (select id from r order by id desc limit 15)")
def logs_dropped(x: Index) -> DataFrame:
    return x.runs.join(navigate.retained_runs(x.runs, keep=15), "id", "left_anti").select("id", "operation", "status")


@query("select root, status, count(*) as runs, min(started_at) as first_start, max(finished_at) as last_finish from r group by 1, 2")
def runs_by_root(x: Index) -> DataFrame:
    return x.runs.groupBy("root", "status").agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"))


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The oldest row of each file as what an index holds, the newest as what a scan finds; style sheets are gone from the checkout."""
    rows = spark.read.parquet(f"{d}/files.parquet")
    old = rows.groupBy("path").agg(F.min(F.struct("mtime", "content_hash", "index_status")).alias("r")).select("path", "r.content_hash", "r.index_status")
    return old, newest_files(rows).where("language is null or language <> 'css'").select("path", "content_hash", "index_status")


STATES = """, o as (select path, content_hash, index_status from (select *, row_number() over (partition by path order by mtime, content_hash) as rn from (select distinct * from files)) where rn = 1),
n as (select path, content_hash, index_status from f where language is null or language <> 'css'),
u as (select coalesce(o.path, n.path) as path, o.index_status as was, n.index_status as now, case when n.path is null then case when o.index_status = 'indexed' then 'deleted' else 'none' end
  when o.content_hash = n.content_hash then 'unchanged' when n.index_status = 'indexed' then case when coalesce(o.index_status, 'skipped') = 'skipped' then 'added' else 'updated' end
  when o.index_status = 'indexed' then 'deleted' else 'none' end as outcome, n.path is null as removed from o full join n on o.path = n.path)
"""


def states(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(*_states(spark, d))
        SQL[f.__name__] = CLEAN + STATES + sql
        return f

    return add


@states("select path, was, now, outcome, removed from u")
def update_outcomes(old: DataFrame, new: DataFrame) -> DataFrame:
    return incremental.reconcile(old, new)


@states("select count(*) filter (outcome = 'added') as added, count(*) filter (outcome = 'updated') as updated, count(*) filter (outcome = 'deleted') as deleted, count(*) filter (outcome = 'unchanged') as unchanged, "
        "count(*) filter (now = 'skipped' and outcome <> 'unchanged') as skipped from u")
def update_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    return incremental.update_counts(incremental.reconcile(old, new))


@states("select path, index_status from o where not exists (select 1 from n where n.path = o.path)")
def update_removed_anti(old: DataFrame, new: DataFrame) -> DataFrame:
    return incremental.removed_paths(old, new)


@states("select path, content_hash, index_status from o where path in (select path from u where outcome = 'unchanged' and not removed) or path in (select path from u where outcome = 'none' and not removed and false) "
        "union all select path, content_hash, index_status from n where path in (select path from u where outcome <> 'unchanged')")
def update_next_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    outcomes = incremental.reconcile(old, new)
    fresh = new.join(outcomes.where("outcome <> 'unchanged'").select("path"), "path", "left_semi")
    return incremental.next_rows(old, fresh, outcomes)


@query("select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as folder, sha256(string_agg(path || chr(9) || coalesce(content_hash, '-'), chr(1) order by path || chr(9) || coalesce(content_hash, '-'))) as digest from f group by 1"
       .replace("chr(1)", "chr(0)"))
def dirty_set_digest(x: Index) -> DataFrame:
    """The digest of each folder's set of files, as the metadata has it for the changed ones. A set's digest is of all its entries in order, so a folder's paths
    and hashes come together in one row."""
    entry = incremental.dirty_entry(F.col("path"), F.col("content_hash"))
    return x.files.groupBy(F.substring_index("path", "/", 2).alias("folder")).agg(incremental.set_digest(F.collect_list(entry)).alias("digest"))


@query("select content_hash, count(*) as copies, min(path) as first_path from f group by 1 having count(*) > 1")
def duplicate_content_by_hash(x: Index) -> DataFrame:
    return navigate.same_content(x.files)


LANGUAGES = "select id, case " + " ".join(f"when split_part(path, '/', -1) = '{n}' then '{v}'" for n, v in T.LANGUAGE_BY_NAME.items()) + " " + \
    " ".join(f"when lower(regexp_extract(split_part(path, '/', -1), '(\\.[^.]*)$', 1)) = '{e}' then '{v}'" for e, v in T.LANGUAGE_BY_EXTENSION.items()) + " end as language, lower(regexp_extract(split_part(path, '/', -1), '(\\.[^.]*)$', 1)) as extension from f"


@query(LANGUAGES)
def language_detect_map(x: Index) -> DataFrame:
    return x.files.select("id", T.detect_language(F.col("path")).alias("language"), T.extension(F.col("path")).alias("extension"))


@query("select id, language from f where language is not null")
def language_detect_stored(x: Index) -> DataFrame:
    """The languages that the index has stored, made anew from the paths."""
    return x.files.where("language is not null").select("id", T.detect_language(F.col("path")).alias("language"))


@query("select id, path, language from f where index_status = 'indexed' and not exists (select 1 from s where s.file_id = f.id)")
def doc_not_exists_pattern(x: Index) -> DataFrame:
    return navigate.without_symbols(x)


@query("select path, language, line_count, symbol_count from m where line_count >= 60 and symbol_count <= 3 order by line_count desc, path limit 50")
def doc_large_files_few_symbols(x: Index) -> DataFrame:
    return navigate.large_with_few_symbols(x, 60, 3, 50)


def _arrays(x: Index, only: DataFrame) -> DataFrame:
    """file_id, lines of the given files. A file of the index is at most a million bytes long, so its lines fit a row."""
    return (x.lines.join(only, "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("a"))
            .select("file_id", F.transform("a", lambda r: r["text"]).alias("lines")))


def _metrics(x: Index, of: DataFrame) -> DataFrame:
    return line_metrics.with_block_metrics(of.select("file_id", "language"), x.lines).select("file_id", "line_count", "blank_lines", "comment_lines", "code_lines")


@query("select file_id, line_count, blank_lines, comment_lines, code_lines from m")
def metrics_recomputed(x: Index) -> DataFrame:
    """The classification of lines, from the lines themselves, of the files that its SQL, which reads what the index was made with, has rows for;
    metrics_indexed has every indexed file."""
    return _metrics(x, x.metrics)


def _in(delimiters: dict, which: int | None = None) -> str:
    """A case of the language: the delimiter, or whether the trimmed line t starts with one of its prefixes."""
    if which is None:
        return " or ".join(f"(starts_with(t, '{p}') and language in ({', '.join(map(repr, ls))}))" for p, ls in delimiters.items())
    return "case " + " ".join(f"when language in ({', '.join(map(repr, ls))}) then '{p[which]}'" for p, ls in delimiters.items()) + " end"


#: Each line sets the state (in a block comment or not), keeps it or turns it over: f0 is what follows outside of a comment, f1 inside.
@query(f""", e as (select id as file_id, language from f where index_status = 'indexed'),
t as (select file_id, line, language, regexp_replace(text, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') as t, {_in(line_metrics.BLOCK_COMMENTS, 0)} as o, {_in(line_metrics.BLOCK_COMMENTS, 1)} as c from l join e using (file_id)),
u as (select *, t = '' as blank, coalesce({_in(line_metrics.LINE_COMMENTS)}, false) as hash, coalesce(starts_with(t, o), false) as opens, coalesce(strpos(t, o) > 0 and not contains(substr(t, strpos(t, o) + length(o)), c), false) as unclosed from t),
v as (select *, case when blank then 0 when opens then unclosed::int when hash then 0 else unclosed::int end as f0, case when blank then 1 when c is null then 1 else (not contains(t, c))::int end as f1 from u),
y as (select *, coalesce(max(case when f0 = f1 then f0 end) over (partition by file_id, h), 0) as base from (select *, sum((f0 = f1)::int) over (partition by file_id order by line) as h from v)),
z as (select file_id, line, blank, opens, hash, (f0 = 1 and f1 = 0)::int as swap, h, base from y),
s2 as (select *, (base + coalesce(sum(swap) over (partition by file_id, h order by line), 0)) % 2 as after from z),
k as (select *, coalesce(lag(after) over (partition by file_id order by line), 0) as inside from s2)
select e.file_id, count(k.line)::int as line_count, (count(*) filter (k.blank))::int as blank_lines, (count(*) filter (not k.blank and (k.inside = 1 or k.opens or k.hash)))::int as comment_lines,
(count(*) filter (not k.blank and not (k.inside = 1 or k.opens or k.hash)))::int as code_lines from e left join k using (file_id) group by 1""")
def metrics_indexed(x: Index) -> DataFrame:
    """The same of every indexed file, whether the index has stored a row for it or not."""
    return _metrics(x, x.files.where("index_status = 'indexed'").select(F.col("id").alias("file_id"), "language"))


SYMBOLS = 'select file_id, path, language, kind, name, line, end_line, "column", signature, context from s where language {}'


@query(SYMBOLS.format("in ('python', 'javascript', 'typescript', 'java', 'ruby', 'c', 'shell')"))
def symbols_spec_engine(x: Index) -> DataFrame:
    """The symbols by patterns, from the lines themselves; the SQL reads what the index was made with."""
    of = x.files.where((F.col("index_status") == "indexed") & F.col("language").isin(*[n for n in SPECS if n != "go"])).select(F.col("id").alias("file_id"), "path", "language")
    return line_symbols(x.lines, of)


@query("""select file_id, path, kind, name, line, case when kind in ('function', 'method') then end_line end as end_line, "column", case when kind in ('function', 'method') then signature end as signature, context
from s where language = 'go'""")
def symbols_go_scanner(x: Index) -> DataFrame:
    """Declarations of Go files, from the lines themselves. The rows of the index end values on their first line, whatever brackets they leave open; the scanner
    follows the brackets, so the ends of functions and methods alone are compared."""
    of = x.files.where((F.col("index_status") == "indexed") & (F.col("language") == "go")).select(F.col("id").alias("file_id"), "path", "language")
    found = scanned_symbols(_arrays(x, of.select("file_id")).join(of, "file_id"))
    runs = F.col("kind").isin("function", "method")
    return found.select("file_id", "path", "kind", "name", "line", F.when(runs, F.col("end_line")).alias("end_line"), "column", F.when(runs, F.col("signature")).alias("signature"), "context")


TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\\pL\\pN]+'), lambda t: t <> '')"


def _fts(x: Index, text: str) -> DataFrame:
    docs = x.symbols.select("id", "name", "signature", "path")
    return fulltext.match(fulltext.postings(docs, "id", ["name", "signature", "path"]), "id", text)


HAS = "(list_contains({t0}, '{w}') or list_contains({t1}, '{w}') or list_contains({t2}, '{w}'))"


def has(word: str) -> str:
    return HAS.format(t0=TOKENS.format("name"), t1=TOKENS.format("signature"), t2=TOKENS.format("path"), w=word)


@query(f"select id from s where {has('harbor')} and {has('ledger')}")
def fts_term(x: Index) -> DataFrame:
    return _fts(x, "Harbor AND ledger")


@query(f"select id from s where {has('harbor')} and not {has('python')} and not {has('lib')}")
def fts_not(x: Index) -> DataFrame:
    return _fts(x, "harbor NOT python NOT lib")


@query("select id from s where " + " or ".join(f"len(list_filter({TOKENS.format(c)}, lambda t: starts_with(t, 'resol'))) > 0" for c in ("name", "signature", "path")))
def fts_prefix(x: Index) -> DataFrame:
    return _fts(x, "resol*")


@query("select id from s where " + " or ".join(f"contains(' ' || array_to_string({TOKENS.format(c)}, ' ') || ' ', ' nested harbor ')" for c in ("name", "signature", "path")))
def fts_phrase(x: Index) -> DataFrame:
    return _fts(x, '"nested harbor"')


@query(f"select id from s where list_contains({TOKENS.format('name')}, 'harbor')")
def fts_column(x: Index) -> DataFrame:
    return _fts(x, "name:harbor")


def _all_fields(x: Index, text: str) -> DataFrame:
    return fulltext.match(fulltext.symbol_postings(x.symbols), "key", text).withColumnRenamed("key", "id")


def _any(test: str) -> str:
    return " or ".join("(" + test.format(TOKENS.format(f'"{c}"' if c == "column" else f"coalesce({c}, '')")) + ")" for c in fulltext.SYMBOL_FIELDS)


@query("select id from s where (" + _any("list_contains({}, 'harbor')") + ") and not (" + _any("list_contains({}, 'python')") + ")")
def fts_symbols_all(x: Index) -> DataFrame:
    """Over all six fields of symbols, so that a language and a word of the context count."""
    return _all_fields(x, "harbor NOT python")


CONTENT = f""", d as (select file_id, {TOKENS.format("string_agg(text, chr(10) order by line)")} as ts from l where file_id in (select id from f where index_status = 'indexed') group by 1)
"""


def _content(x: Index, text: str) -> DataFrame:
    return fulltext.match(fulltext.file_postings(x.files, x.lines), "key", text).withColumnRenamed("key", "id")


@query(CONTENT + "select file_id as id from d where list_contains(ts, 'harbor') and not list_contains(ts, 'ledger') and list_contains(ts, 'return')")
def fts_content_term(x: Index) -> DataFrame:
    """Over the contents of files."""
    return _content(x, "content:harbor content:return NOT content:ledger")


@query(CONTENT + "select file_id as id from d where contains(' ' || array_to_string(ts, ' ') || ' ', ' end end def ')")
def fts_content_phrase(x: Index) -> DataFrame:
    """A phrase goes on from line to line."""
    return _content(x, 'content:"end end def"')


def _sql(x: Index, text: str) -> DataFrame:
    x.views()
    return sqlgate.run(x.files.sparkSession, text)


@query("select language, kind, count(*) as n, count(distinct file_id) as in_files from s group by 1, 2 having count(*) > 5")
def sql_passthrough_group(x: Index) -> DataFrame:
    return _sql(x, "select language, kind, count(*) as n, count(distinct file_id) as in_files from symbols group by language, kind having count(*) > 5 limit -1;")


@query("select path, line_count, rank_in_language from (select path, language, line_count, rank() over (partition by language order by line_count desc, path) as rank_in_language from m) where rank_in_language <= 3")
def sql_passthrough_window(x: Index) -> DataFrame:
    return _sql(x, 'with w as (select path, line_count, rank() over (partition by language order by line_count desc, path) as rank_in_language from file_metrics) select path, "line_count", rank_in_language from w where rank_in_language <= 3')


@query(f"select path, size // 1000 as kilobytes from f where {fold('path')} like '%readme%' or {fold('path')} like '%.py'")
def sql_passthrough_like(x: Index) -> DataFrame:
    """LIKE folds ASCII case, a GLOB is a pattern, and integers divide to integers."""
    return _sql(x, "select path, size / 1000 as kilobytes from files where path like '%README%' or path glob '*.[pP][yY]'")


@query(f"select path, size // 7 // 3 as n, (size + mtime) // 1000 as m from f where {fold('path')} like '%.py' and not {fold('language')} like 'j%' and {fold('extension')} = '.py'")
def sql_passthrough_expressions(x: Index) -> DataFrame:
    """LIKE over an expression, NOT LIKE, a comparison without case, and divisions of columns and expressions."""
    return _sql(x, "select path, size / 7 / 3 as n, (size + mtime) / 1000 as m from files where path like '%' || '.PY' and language not like 'J' || '%' and extension = '.Py' collate nocase")


@query("select language from f where language is not null except select language from s where kind = 'class' union select 'none' as language")
def sql_passthrough_sets(x: Index) -> DataFrame:
    return _sql(x, "select language from files where language is not null except select language from symbols where kind = 'class' union select 'none' as language")


@query("select language from f where index_status = 'skipped' intersect select language from s")
def sql_passthrough_intersect(x: Index) -> DataFrame:
    return _sql(x, "select language from files where index_status = 'skipped' intersect select language from symbols")


@query("select language, string_agg(kind, '|' order by kind) as kinds from (select distinct language, kind from s) group by 1")
def sql_passthrough_concat(x: Index) -> DataFrame:
    """The order within a list is the query's, so each list is sorted outside."""
    lists = _sql(x, "select language, group_concat(distinct kind, '|') as kinds from symbols group by language")
    return lists.select("language", F.array_join(F.array_sort(F.split("kinds", r"\|")), "|").alias("kinds"))


@query("select f.path, count(*) as n, max(length(l.text)) as longest from f join l on l.file_id = f.id left join m on m.file_id = f.id where m.file_id is null or m.code_lines > 50 group by 1")
def sql_passthrough_join(x: Index) -> DataFrame:
    return _sql(x, "select f.path, count(*) as n, max(length(l.text)) as longest from files f join lines l on l.file_id = f.id left join file_metrics m on m.file_id = f.id where m.file_id is null or m.code_lines > 50 group by f.path")


@query(r"select id, coalesce(try_cast(regexp_extract(path, '/[a-z]*0*([0-9]+)/', 1) as bigint), 0) as n from f")
def sql_passthrough_cast(x: Index) -> DataFrame:
    """A cast takes the number that a text begins with."""
    return _sql(x, "select id, cast(regexp_extract(path, '/[a-z]*0*([0-9]+/)', 1) as integer) as n from files")


def table(name: str, sql: str) -> Callable:
    """Registers a query over one stored table, with its SQL."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(spark.read.parquet(f"{d}/{name}.parquet"))
        SQL[f.__name__] = sql
        return f

    return add


@table("documents", "select doc_id, sha256(text) as content_hash from documents where text is not null")
def content_hash(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@table("documents", """with t as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as a from documents where text is not null)
select doc_id, cast(case when a[-1] = '' then len(a) - 1 else len(a) end as integer) as n_lines, cast(len(list_filter(a, lambda x: trim(x, ' ' || chr(9)) = '')) - case when a[-1] = '' then 1 else 0 end as integer) as n_blank from t""")
def lines_explode_count(docs: DataFrame) -> DataFrame:
    """The lines of each text as the index splits them."""
    lines = docs.where("text is not null").select("doc_id", T.split_lines(F.col("text")).alias("a"))
    return lines.select("doc_id", F.size("a").alias("n_lines"), F.size(F.filter("a", lambda x: T.trim_space(x) == "")).alias("n_blank"))


@table("build_runs", """with r as (select distinct * from build_runs) select date_trunc('hour', cast(replace(started_at, 'Z', '') as timestamp)) as window_start,
date_trunc('hour', cast(replace(started_at, 'Z', '') as timestamp)) + interval 1 hour as window_end, root, status, count(*) as runs from r group by 1, 2, 3, 4""")
def runs_per_hour(runs: DataFrame) -> DataFrame:
    """The stream's windows over the whole log; late rows are there like others."""
    from .streaming.feeds import run_rates

    return run_rates(runs.dropDuplicates(["id"]))


def schema_catalog(spark: SparkSession, d: str) -> DataFrame:
    from .model import catalog_rows

    return spark.createDataFrame(catalog_rows(), "table_name string, ordinal int, column_name string, type string, nullable boolean, key_place int")


def _schema_sql() -> str:
    from .model import catalog_rows

    text = lambda v: "null" if v is None else (f"'{v}'" if isinstance(v, str) else str(v).lower())
    return "select * from (values " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in catalog_rows()) + ") v(table_name, ordinal, column_name, type, nullable, key_place)"


QUERIES["schema_catalog"] = schema_catalog
SQL["schema_catalog"] = _schema_sql()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
