"""Project configuration: the first file found counts, nothing is merged, unknown keys are errors."""

from __future__ import annotations

import hashlib
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .decode import checked_fallbacks

MAX_BYTES = 1_000_000
# Directories and extensions that are never indexed.
IGNORED_DIRS = [".bundle", ".cache", ".git", ".gradle", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".terraform", ".venv", ".vscode", "__pycache__", "bazel-bin", "bazel-out",
                "bazel-testlogs", "build", "coverage", "deps", "dist", "node_modules", "out", "pkg", "target", "tmp", "vendor", "venv"]
BINARY_EXTENSIONS = [".7z", ".a", ".bin", ".bmp", ".bundle", ".class", ".dll", ".dylib", ".exe", ".gif", ".ico", ".jar", ".jpeg", ".jpg", ".lock", ".mp3", ".mp4", ".o", ".pdf", ".png", ".pyc", ".rlib", ".so",
                     ".sqlite", ".sqlite3", ".wasm", ".wav", ".webp", ".zip"]
NAME = ".loamdex.toml"


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    max_bytes: int = MAX_BYTES
    ignore_dirs: list[str] = field(default_factory=list)
    db: str | None = None
    fallbacks: list[str] = field(default_factory=list)

    def ignored(self) -> list[str]:
        return sorted({*IGNORED_DIRS, *self.ignore_dirs})


def parse(path: Path, project: bool) -> Config:
    raw = tomllib.loads(path.read_text())
    known = {"max_bytes", "ignore_dirs"} | ({"db", "encoding"} if project else set())
    if odd := sorted(set(raw) - known):
        raise ConfigError(f"{path}: unknown key {odd[0]}")
    c = Config()
    if "max_bytes" in raw:
        if not isinstance(raw["max_bytes"], int) or isinstance(raw["max_bytes"], bool) or raw["max_bytes"] <= 0:
            raise ConfigError(f"{path}: max_bytes must be a positive number")
        c.max_bytes = raw["max_bytes"]
    c.ignore_dirs = list(raw.get("ignore_dirs", []))
    if "db" in raw:
        db = raw["db"]
        if not db or os.path.isabs(db) or os.path.normpath(db).startswith(".."):
            raise ConfigError(f"{path}: db must be relative and stay inside the root")
        c.db = db
    enc = raw.get("encoding", {})
    if odd := sorted(set(enc) - {"fallbacks"}):
        raise ConfigError(f"{path}: unknown key encoding.{odd[0]}")
    try:
        c.fallbacks = checked_fallbacks(enc.get("fallbacks", []))
    except ValueError as e:
        raise ConfigError(f"{path}: {e}") from e
    return c


def resolve(root: Path, user: Path | None = None) -> Config:
    if (p := root / NAME).is_file():
        return parse(p, project=True)
    if user and user.is_file():
        return parse(user, project=False)
    return Config()


def default_store(root: Path, environment: dict[str, str] | None = None) -> Path:
    """Where an index lives if nothing says otherwise: a cache folder and the start of the root's digest."""
    env = environment if environment is not None else dict(os.environ)
    base = Path(env["LOAMDEX_CACHE"]) if env.get("LOAMDEX_CACHE") else Path(env.get("XDG_CACHE_HOME") or Path(env.get("HOME", "~")).expanduser() / ".cache") / "loamdex"
    return base / hashlib.sha256(str(root.resolve()).encode()).hexdigest()[:16]


def store_of(root: Path, config: Config, given: str | None = None) -> Path:
    return Path(given) if given else (root / config.db if config.db else default_store(root))
