"""The command line: one command per query, as text or JSON."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .model import POSTINGS, SCHEMA_VERSION, catalog_rows
from .operators import fulltext, navigate
from .plans import build, sqlgate
from .plans import status as state
from .session import ship
from .sources import git
from .sources.config import resolve, store_of
from .sources.snapshot import Store


SUMMARIES = {
    "help": "say how commands are used", "version": "say which version this is", "path": "say where the index is kept", "init": "make an empty index", "rebuild": "make the index anew", "update": "bring the index up to date",
    "defs": "find definitions", "outline": "list a file's symbols", "refs": "find where a name is defined and used", "files": "list files", "metrics": "count lines by language or file", "show": "show lines of a file",
    "sql": "run one query that only reads", "match": "search words in symbols or files", "schema": "list tables and columns", "stats": "count what is in the index", "status": "say whether the index is up to date", "logs": "list the newest runs",
}


def usages() -> dict[str, str]:
    """How each command is called."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    return {n: " ".join(p.format_usage().removeprefix("usage:").split()) for n, p in commands.items()}


def help_of(topic: str | None, as_object: bool) -> str:
    use = usages()
    if topic is not None:
        if topic not in use:
            raise ValueError(f"unknown command {topic!r}")
        return as_json({"name": topic, "usage": use[topic], "summary": SUMMARIES[topic]}) if as_object else f"usage: {use[topic]}\n\n{SUMMARIES[topic]}"
    if as_object:
        return as_json({"usage": " ".join(parser().format_usage().removeprefix("usage:").split()), "commands": [{"name": n, "usage": u, "summary": SUMMARIES[n]} for n, u in use.items()]})
    return "\n".join([parser().format_usage().strip(), "", *(f"  {n:<10}{SUMMARIES[n]}" for n in use)])


def version() -> dict[str, object]:
    """The release, and of a checkout its commit and whether it has been changed; null where that isn't known."""
    here = Path(__file__).resolve().parent
    inside = git.is_work_tree(here) and (git.git(here, "ls-files", "--error-unmatch", Path(__file__).name) is not None)
    commit = (git.git(here, "rev-parse", "HEAD") or "").strip() if inside else ""
    changed = git.git(here, "status", "--porcelain", "--untracked-files=no", "--", ".") if commit else None
    return {"version": __version__, "commit": commit or None, "modified": None if changed is None else bool(changed.strip()), "schema_version": int(SCHEMA_VERSION), "file_source": build.FILE_SOURCE}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamdex", description="Index tracked source files and query them.")
    p.add_argument("--root", default=None)
    p.add_argument("--db", default=None)
    p.add_argument("--format", choices=["text", "json"], default="text")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("help", help=SUMMARIES["help"])
    c.add_argument("topic", nargs="?")
    for name in ("version", "path", "init", "schema", "stats", "status"):
        sub.add_parser(name, help=SUMMARIES[name])
    for name in ("rebuild", "update"):
        c = sub.add_parser(name, help=SUMMARIES[name])
        c.add_argument("--verbose", "-v", action="store_true")
        c.add_argument("--max-bytes", type=int)
        c.add_argument("--ignore-dir", action="append", default=[])
        if name == "update":
            c.add_argument("--adopt", action="store_true")
    for name, limit in (("defs", 50), ("files", 100), ("metrics", 100)):
        c = sub.add_parser(name, help=SUMMARIES[name])
        c.add_argument("query", nargs="?")
        c.add_argument("--language")
        c.add_argument("--limit", type=int, default=limit)
        if name != "metrics":
            c.add_argument("--list", action="store_true")
        if name == "defs":
            c.add_argument("--kind")
        if name == "files":
            c.add_argument("--status", default="indexed")
    c = sub.add_parser("outline", help=SUMMARIES["outline"])
    c.add_argument("file")
    c = sub.add_parser("show", help=SUMMARIES["show"])
    c.add_argument("file")
    c.add_argument("--line", type=int, required=True)
    c.add_argument("--context", type=int, default=3)
    c = sub.add_parser("refs", help=SUMMARIES["refs"])
    c.add_argument("name")
    c.add_argument("--kind", action="append", default=[])
    c.add_argument("--language")
    c.add_argument("--ignore-case", action="store_true")
    c.add_argument("--limit", type=int, default=100)
    c = sub.add_parser("sql", help=SUMMARIES["sql"])
    c.add_argument("query", nargs="?")
    c = sub.add_parser("match", help=SUMMARIES["match"])
    c.add_argument("query")
    c.add_argument("--content", action="store_true", help="search paths, languages and contents of files instead of symbols")
    c = sub.add_parser("logs", help=SUMMARIES["logs"])
    c.add_argument("--limit", type=int, default=20)
    return p


def tsv(df: DataFrame) -> str:
    """Rows parted by tabs under a header; nothing at all without rows."""
    rows = df.collect()
    return "\n".join(["\t".join(df.columns)] + ["\t".join("" if v is None else str(v) for v in r) for r in rows]) if rows else ""


def as_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def rows_json(df: DataFrame, ordered: bool = True) -> str:
    out = [r.asDict(recursive=True) for r in df.collect()]
    return as_json(out if ordered else [dict(sorted(r.items())) for r in out])


def refs_text(name: str, definitions: list[dict], candidates: list[dict]) -> str:
    out = [f"definitions of {name}: {len(definitions)}"] + [f"  {d['path']}:{d['line']} {d['kind']} {d['name']}" for d in definitions] + [f"candidates: {len(candidates)}"]
    for c in candidates:
        scope = " > ".join(f"{s['kind']} {s['name']}" for s in c["scopes"])
        out.append(f"  {c['path']}:{c['line']}{' in ' + scope if scope else ''}\n    {c['text'].strip()}")
    return "\n".join(out)


def run(argv: list[str], spark: SparkSession) -> str:
    """The output of a command; ValueError and OSError for wrong arguments and missing indexes."""
    a = parser().parse_args(argv)
    if a.command == "help":
        return help_of(a.topic, a.format == "json")
    if a.command == "version":
        v = version()
        return as_json(v) if a.format == "json" else "\n".join(["key\tvalue", *(f"{k}\t{x}" for k, x in v.items() if x is not None)])
    ship(spark)
    root = Path(a.root or (git.git(Path.cwd(), "rev-parse", "--show-toplevel") or str(Path.cwd())).strip()).resolve()
    config = resolve(root)
    store = Store(store_of(root, config, a.db))
    show = lambda df: rows_json(df) if a.format == "json" else tsv(df)
    if a.command == "path":
        return as_json({"db": str(store.folder)}) if a.format == "json" else str(store.folder)
    if a.command in ("init", "rebuild", "update"):
        if a.command != "init":
            config.max_bytes = a.max_bytes if a.max_bytes is not None else config.max_bytes
            config.ignore_dirs = [*config.ignore_dirs, *a.ignore_dir]
        r = build.init(spark, store, root, config) if a.command == "init" else build.rebuild(spark, store, root, config) if a.command == "rebuild" else build.update(spark, store, root, config, a.adopt)
        v = {"operation": r.operation, "db": str(store.folder), "skipped": r.skipped, **r.counts} if not r.skipped else {"operation": r.operation, "db": str(store.folder), "skipped": True, "reason": "locked"}
        return as_json(v) if a.format == "json" else "\n".join(f"{k}: {x}" for k, x in v.items())
    if a.command == "status":
        v = state.status(spark, store, root, config)
        return as_json(v) if a.format == "json" else state.as_text(v)
    if a.command == "schema":
        rows = [dict(zip(("table", "ordinal", "column", "type", "nullable", "primary_key"), r)) for r in catalog_rows()]
        return as_json(rows) if a.format == "json" else "\n".join("\t".join(str(x) for x in (r["table"], r["ordinal"], r["column"], r["type"], "yes" if r["nullable"] else "no", r["primary_key"] or "-")) for r in rows)
    if a.command == "logs":
        from .sources.tables import Index

        return show(navigate.logs(Index(*[None] * 4, runs=store.runs(spark)), a.limit))
    x = store.read(spark)
    if a.command in ("defs", "files"):
        if a.list == (a.query is not None):
            raise ValueError("give either a query or --list")
        if a.command == "files":
            return show(navigate.files(x, a.query, a.status, a.language, a.limit))
        return show(navigate.defs_list(x, a.kind, a.language, a.limit) if a.list else navigate.defs(x, a.query, a.kind, a.language, a.limit))
    if a.command == "metrics":
        return show(navigate.metrics_summary(x, a.language, a.limit) if a.query is None else navigate.metrics_files(x, a.query, a.language, a.limit))
    if a.command == "outline":
        return show(navigate.outline(x, a.file))
    if a.command == "show":
        return show(navigate.show(x, a.file, a.line, a.context))
    if a.command == "stats":
        return as_json({r["key"]: r["value"] for r in navigate.stats(x).collect()}) if a.format == "json" else tsv(navigate.stats(x))
    if a.command == "refs":
        if not a.name or any(not k for k in a.kind):
            raise ValueError("refs needs a name, and kinds must not be empty")
        found = [r.asDict(recursive=True) for r in navigate.refs(x, a.name, a.language, a.ignore_case, a.limit).collect()]
        defined = [r.asDict() for r in navigate.refs_definitions(x, a.name, a.kind, a.language, a.ignore_case).collect()]
        return as_json({"name": a.name, "kinds": sorted(set(a.kind)), "definitions": defined, "candidates": found}) if a.format == "json" else refs_text(a.name, defined, found)
    if a.command == "match":
        if missing := [n for n in POSTINGS if n not in store.tables()]:
            raise ValueError(f"the index has no full-text tables ({', '.join(missing)}); rebuild it")
        if a.content:
            hits = fulltext.match(x.files_postings, "key", a.query).withColumnRenamed("key", "id")
            return show(x.files.join(hits, "id", "left_semi").orderBy("path", "id").select(*navigate.FILE_LIST_COLUMNS))
        hits = fulltext.match(x.symbols_postings, "key", a.query).withColumnRenamed("key", "id")
        return show(x.symbols.join(hits, "id", "left_semi").orderBy("path", "line", "column", "name").select(*navigate.SYMBOL_COLUMNS))
    x.views()
    df = sqlgate.run(spark, a.query if a.query is not None else sys.stdin.read())
    return rows_json(df, ordered=False) if a.format == "json" else tsv(df)


def main() -> int:
    spark = SparkSession.builder.appName("loamdex").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(run(sys.argv[1:], spark))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
