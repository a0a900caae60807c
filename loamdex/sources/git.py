"""The version-control source: tracked paths, changed paths, and where the checkout stands."""

from __future__ import annotations

import posixpath
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_language, extension
from .config import BINARY_EXTENSIONS, Config
from .decode import NotText, decode

SCAN = ("path string, language string, extension string, size bigint, mtime bigint, content_hash string, index_status string, source_encoding string, encoding_source string, transcoded int, skip_reason string, text string")


def git(root: Path, *args: str) -> str | None:
    """Output of a git command, null if it fails."""
    try:
        r = subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=False)
    except OSError:
        return None
    return r.stdout.decode("utf-8", "surrogateescape") if r.returncode == 0 else None


def is_work_tree(root: Path) -> bool:
    return (git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def listed(text: str | None) -> list[str] | None:
    return None if text is None else [p for p in text.split("\0") if p]


def tracked(root: Path) -> list[str]:
    if not is_work_tree(root):
        raise ValueError(f"{root} is not a Git work tree")
    return listed(git(root, "ls-files", "-z")) or []


def clean(path: str) -> str | None:
    """A path below the root without empty parts and dots; null if it leaves the root."""
    out = posixpath.normpath(path)
    return None if out in (".", "..") or out.startswith(("/", "../")) else out


def keep(path: str, config: Config) -> bool:
    """Whether no part of a path is ignored, its name included, and its extension isn't one of binary files."""
    ignored = set(config.ignored())
    name = path.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return not ignored & set(path.split("/")) and ext not in BINARY_EXTENSIONS


def scan(spark: SparkSession, root: Path, config: Config, candidates: set[str] | None = None, per_task: int = 200) -> DataFrame:
    """One row per tracked file that is read: the columns of the files table without id, and the text (null if skipped).

    The paths are listed on the driver; the executors read the files by path, so nothing is left out for how it is named. Symbolic links, other
    special files, files over the limit, unreadable files and files that aren't text give no row.
    """
    paths = sorted({c for p in tracked(root) if (c := clean(p)) and keep(c, config) and (candidates is None or c in candidates)})
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // per_task))
    base, most, fallbacks = str(root), config.max_bytes, list(config.fallbacks)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os
        import stat

        for pdf in batches:
            rows = []
            for p, language, ext in zip(pdf["path"], pdf["language"], pdf["extension"]):
                full = os.path.join(base, p)
                try:
                    info = os.lstat(full)
                    if not stat.S_ISREG(info.st_mode) or info.st_size > most:
                        continue
                    with open(full, "rb") as f:
                        data = f.read()
                    d = decode(data, language, fallbacks)
                except (OSError, NotText):
                    continue
                rows.append((p, language, ext, len(data), int(info.st_mtime), hashlib.sha256(data).hexdigest(), d.index_status, d.source_encoding, d.encoding_source, d.transcoded, d.skip_reason, d.text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN.split(", ")]).astype({"size": "int64", "mtime": "int64", "transcoded": "int32"})

    return df.select("path", detect_language(F.col("path")).alias("language"), extension(F.col("path")).alias("extension")).mapInPandas(read, SCAN)


def differing(root: Path, *between: str) -> list[str] | None:
    """Paths below the root that differ between revisions, index and work tree. A renamed file counts under both names."""
    return listed(git(root, "diff", "--name-only", "--no-renames", "--relative", "-z", *between, "--", "."))


def changed(root: Path, since: str | None, was_dirty: bool) -> set[str] | None:
    """Paths that can differ from the index: committed since, unstaged and staged. Null for all, whenever that can't be told."""
    head = (git(root, "rev-parse", "HEAD") or "").strip()
    if not since or was_dirty or not head:
        return None
    parts = [differing(root, since, head), differing(root), differing(root, "--cached")]
    return None if any(p is None for p in parts) else {p for part in parts for p in part or []}


def state(root: Path) -> dict[str, str]:
    """The checkout's metadata; what isn't known isn't there."""
    out = {"vcs_kind": "git"}
    head = (git(root, "rev-parse", "HEAD") or "").strip()
    branch = (git(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip()
    if head:
        out |= {"vcs_revision": head, "vcs_head": head, "vcs_ref": branch or head}
    if branch:
        out["vcs_branch"] = branch
    status = git(root, "status", "--porcelain", "--untracked-files=no")
    if status is not None:
        out["vcs_dirty"] = "1" if status.strip() else "0"
        if status.strip():
            out["vcs_dirty_hash"] = dirty_hash(root)
    return out


def dirty_hash(root: Path, config: Config | None = None) -> str:
    """Digest of the changed paths and contents. The default configuration counts, not the project's."""
    import hashlib

    c = config or Config()
    paths = sorted({p for a in ((), ("--cached",)) for p in differing(root, *a) or [] if keep(p, c)})
    entries = []
    for p in paths:
        f = root / p
        entries.append(f"{p}\t{hashlib.sha256(f.read_bytes()).hexdigest() if f.is_file() and not f.is_symlink() else '-'}")
    return hashlib.sha256("\0".join(sorted(entries)).encode("utf-8", "surrogateescape")).hexdigest()


def commit_exists(root: Path, revision: str) -> bool:
    return git(root, "cat-file", "-e", f"{revision}^{{commit}}") is not None
