"""Text expressions, all built in: folding of ASCII letters, pattern matching without case, identifiers, lines, languages."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: White space as the index trims it; Java's own classes and trim() differ.
SPACE = r"[\t-\r\x{85}\p{Z}]"
SIGNATURE_BYTES, CONTEXT_BYTES = 500, 2000

# Languages by file name and by extension.
LANGUAGE_BY_NAME = {"Brewfile": "ruby", "Dockerfile": "dockerfile", "Gemfile": "ruby", "Justfile": "make", "Makefile": "make", "Rakefile": "ruby"}
LANGUAGE_BY_EXTENSION = {
    ".bash": "shell", ".c": "c", ".cc": "cpp", ".cljs": "clojure", ".clj": "clojure", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".cxx": "cpp", ".el": "elisp", ".ex": "elixir", ".exs": "elixir",
    ".go": "go", ".h": "c", ".hpp": "cpp", ".hs": "haskell", ".html": "html", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua", ".mjs": "javascript",
    ".php": "php", ".py": "python", ".rake": "ruby", ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".scm": "scheme", ".sh": "shell", ".swift": "swift", ".ts": "typescript", ".tsx": "typescript",
    ".vue": "vue", ".zsh": "shell",
}


def ascii_fold(c: Column) -> Column:
    """Lower case for A to Z alone; lower() and ilike() fold all of Unicode."""
    return F.translate(c, UPPER, LOWER)


def ascii_lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def equals_nocase(c: Column, value: str) -> Column:
    return ascii_fold(c) == F.lit(ascii_lower(value.replace("\0", "")))


def like_nocase(c: Column, pattern: str) -> Column:
    """LIKE without an escape character and without regard to the case of ASCII letters: % and _ of the user are wildcards, a backslash is one."""
    p = ascii_lower(pattern.replace("\0", ""))
    escape = next(x for x in "~^!|`\x01\x02" if x not in p)
    return F.call_function("like", ascii_fold(c), F.lit(p), F.lit(escape))


def contains_nocase(c: Column, value: str) -> Column:
    return like_nocase(c, f"%{value}%")


def identifier(c: Column, name: str, ignore_case: bool = False) -> Column:
    """Whether the name stands in c as a whole identifier: no letter, decimal digit, _ or $ beside it.

    A cheap test for the substring goes first. Without ASCII in the name there is none that folds like the match does.
    """
    edge = r"[_$\p{L}\p{Nd}]"
    quoted = r"\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E"
    match = c.rlike(rf"{'(?iu)' if ignore_case else ''}(?<!{edge}){quoted}(?!{edge})")
    if not ignore_case:
        return F.contains(c, F.lit(name)) & match
    return F.contains(ascii_fold(c), F.lit(ascii_lower(name))) & match if name.isascii() else match


def split_lines(c: Column) -> Column:
    """Lines of a text: CRLF and CR are line ends too, one empty line at the end is none, an empty text has none."""
    parts = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows, in lower case; '' without a dot."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def detect_language(path: Column) -> Column:
    """By base name, case-sensitively, then by extension; null if neither is known."""
    return F.coalesce(F.try_element_at(_map(LANGUAGE_BY_NAME), basename(path)), F.try_element_at(_map(LANGUAGE_BY_EXTENSION), extension(path)))


def truncate_bytes(c: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, cut at the last whole character."""
    raw = F.encode(c, "UTF-8")
    inside = lambda i: F.substring(F.hex(F.substring(raw, i, 1)), 1, 1).isin("8", "9", "A", "B")  # noqa: E731  a byte that goes on a character
    k = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substr(raw, F.lit(1), k), "UTF-8"))


def context(lines: Column, line: Column, reach: int = 2) -> Column:
    """The line with its neighbours, as far as there are any, joined by line ends."""
    first = F.greatest(line - reach, F.lit(1))
    return truncate_bytes(F.array_join(F.slice(lines, first, line + reach - first + 1), "\n"), CONTEXT_BYTES)


def signature(line: Column) -> Column:
    return truncate_bytes(trim_space(line), SIGNATURE_BYTES)


def normalized_path(path: str) -> str:
    """A path as the index keeps it: relative, with /, without . and .. components."""
    import posixpath

    p = posixpath.normpath(path.replace("\\", "/")).lstrip("/")
    return "" if p == "." else p


def like_regex(pattern: str) -> str:
    """The regular expression that matches like LIKE does; for tests."""
    return "^" + "".join({"%": ".*", "_": "."}.get(ch, re.escape(ch)) for ch in pattern) + "$"
