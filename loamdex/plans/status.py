"""What is known of an index and the checkout it is of, as typed values; what isn't known is null."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import git
from ..sources.config import Config
from ..sources.snapshot import Store
from . import build


def _number(v: str) -> int | None:
    return int(v) if v.lstrip("-").isdigit() else None


def _flag(v: str) -> bool | None:
    return {"1": True, "0": False}.get(v)


def _list(v: str) -> list[str] | None:
    try:
        return [str(x) for x in json.loads(v)]
    except (ValueError, TypeError):
        return None


# The stored metadata in the order it is shown in, and the fields of the checkout and the lock.
STORED = "root schema_version file_source hash_algorithm config_max_bytes config_ignore_dirs config_encoding_fallbacks indexed_at updated_at last_operation vcs_kind vcs_head vcs_branch vcs_dirty vcs_dirty_hash vcs_revision vcs_ref fts5".split()
CHECKOUT = "current_vcs_kind current_vcs_head current_vcs_branch current_vcs_dirty update_compatible update_requires_adopt update_rebuild_required update_blocker index_stale".split()
LOCK = "lock lock_operation lock_pid lock_stale lock_started_at lock_root".split()
_READ: dict[str, Callable[[str], object]] = {"schema_version": _number, "config_max_bytes": _number, "config_ignore_dirs": _list, "config_encoding_fallbacks": _list, "vcs_dirty": _flag, "fts5": _flag}


def status(spark: SparkSession, store: Store, root: Path, config: Config) -> dict[str, object]:
    """All fields, in order; those of an index that isn't there, a checkout that isn't one or a lock that nobody has are null."""
    out: dict[str, object] = {"db": str(store.folder), "exists": store.current() is not None, "locked": store.lock_holder() is not None}
    out |= dict.fromkeys([*STORED, "components", *CHECKOUT, *LOCK])
    out |= lock_fields(store)
    if not out["exists"]:
        return out
    x = store.read(spark)
    meta = {r["key"]: r["value"] for r in x.meta.collect()}
    out |= {k: _READ.get(k, str)(meta[k]) for k in STORED if meta.get(k)}
    out["components"] = [r.asDict() for r in x.components.collect()]
    if git.is_work_tree(root):
        now, blocker = git.state(root), build.blocker(meta, root, config)
        out |= {"current_vcs_kind": now["vcs_kind"], "current_vcs_head": now.get("vcs_head"), "current_vcs_branch": now.get("vcs_branch"), "current_vcs_dirty": _flag(now.get("vcs_dirty", "")), "update_compatible": blocker is None,
                "update_requires_adopt": blocker in build.ADOPTABLE, "update_rebuild_required": blocker is not None and blocker not in build.ADOPTABLE, "update_blocker": blocker,
                "index_stale": {"fresh": False, "stale": True}.get(build.freshness(meta, root))}
    return out


def lock_fields(store: Store) -> dict[str, object]:
    """The lock that is there, also one whose holder is gone, which is stale."""
    try:
        held = json.loads((store.folder / "LOCK").read_text())
    except (OSError, ValueError):
        return {}
    return {"lock": str(store.folder / "LOCK"), "lock_operation": held.get("operation"), "lock_pid": held.get("pid"), "lock_stale": store.lock_holder() is None, "lock_started_at": held.get("started_at"), "lock_root": held.get("root")}


def as_text(fields: dict[str, object]) -> str:
    """One field a line, parted by a tab; null ones are left out, flags are yes and no."""
    word = lambda v: {True: "yes", False: "no"}[v] if isinstance(v, bool) else (json.dumps(v) if isinstance(v, list) else str(v))
    rows = [(k, word(v)) for k, v in fields.items() if v is not None and k != "components"]
    rows += [(f"component_{c['name']}", f"{c['status']}") for c in fields.get("components") or []]
    return "\n".join("\t".join(r) for r in rows)
