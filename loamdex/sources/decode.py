"""From bytes to text: byte-order marks, declared encodings, fallbacks, and what is not text."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

SNIFF = 8192
# How sources declare their encoding.
DECLARED = {"python": re.compile(rb"coding[=:][ \t]*([-A-Za-z0-9_.]+)"), "ruby": re.compile(rb"(?:coding|encoding):[ \t]+([-A-Za-z0-9_.]+)")}
# Byte-order marks, the longer before the shorter that starts alike.
MARKS = [(codecs.BOM_UTF32_LE, "UTF-32LE"), (codecs.BOM_UTF32_BE, "UTF-32BE"), (codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")]
ALIASES = {"windows-31j": "cp932", "cp932": "cp932", "ms932": "cp932", "sjis": "shift_jis", "shift-jis": "shift_jis", "eucjp": "euc_jp", "eucjp-ms": "euc_jp", "utf8": "utf-8", "utf8-mac": "utf-8", "ascii-8bit": None, "binary": None,
           "us-ascii": "ascii", "iso-8859-8-i": "iso8859_8", "x-sjis": "shift_jis", "cp65001": "utf-8"}


class NotText(Exception):
    """The bytes are no text; the file gets no row at all."""


@dataclass(frozen=True)
class Decoded:
    text: str | None
    index_status: str = "indexed"
    source_encoding: str | None = None
    encoding_source: str | None = None
    transcoded: int = 0
    skip_reason: str | None = None


def codec(name: str) -> str | None:
    """Python's name of an encoding, null if it has none."""
    key = name.strip().lower().replace("_", "-")
    known = ALIASES.get(key, key)
    if known is None:
        return None
    try:
        return codecs.lookup(known).name
    except LookupError:
        return None


def canonical(name: str) -> str:
    key = re.sub(r"[-_ ]", "", name.strip().lower())
    return {"utf8": "UTF-8", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "utf32le": "UTF-32LE", "utf32be": "UTF-32BE"}.get(key, name.strip())


def equivalent(a: str, b: str) -> bool:
    """A declaration without byte order agrees with either order."""
    x, y = (re.sub(r"[-_ ]", "", canonical(n).lower()) for n in (a, b))
    return x == y or {x, y} <= {"utf16", "utf16le", "utf16be"} and "utf16" in (x, y) or {x, y} <= {"utf32", "utf32le", "utf32be"} and "utf32" in (x, y) or codec(a) is not None and codec(a) == codec(b)


def declared(data: bytes, language: str | None) -> str | None:
    """Ruby declares on the first line, or on the second after a #! line; Python on one of the first two, on the second only after a comment."""
    rx = DECLARED.get(language or "")
    if rx is None:
        return None
    rows = re.split(rb"\r\n|\r|\n", data, maxsplit=2)[:2]
    if language == "ruby":
        row = rows[1] if rows[0].startswith(b"#!") and len(rows) > 1 else rows[0]
        return m[1].decode() if row.lstrip().startswith(b"#") and (m := rx.search(row)) else None
    for i, row in enumerate(rows):
        if not row.lstrip().startswith(b"#"):
            if i == 0 and row.strip():
                return None
            continue
        if m := rx.search(row):
            return m[1].decode()
    return None


def strict(data: bytes, name: str) -> str | None:
    """The text, or null if the bytes aren't valid in the encoding. Half surrogate pairs and odd lengths aren't."""
    c = codec(name)
    if c is None:
        raise LookupError(name)
    try:
        return data.decode(c)
    except UnicodeError:
        return None


def decode(data: bytes, language: str | None = None, fallbacks: list[str] | None = None) -> Decoded:
    """The decision tree for one file; NotText if it isn't text."""
    mark = next(((m, n) for m, n in MARKS if data.startswith(m)), None)
    said = declared(data[len(mark[0]):] if mark and mark[1] == "UTF-8" else data, language)
    if mark:
        name = mark[1]
        text = strict(data[len(mark[0]):], name.replace("LE", "-LE").replace("BE", "-BE") if name != "UTF-8" else name)
        if text is None:
            return Decoded(None, "skipped", name, "bom", 0, "conversion_failed")
        if "\0" in text:
            raise NotText
        if name != "UTF-8":
            said = declared(text.encode("utf-8", "surrogatepass"), language)
        if said and not equivalent(said, name):
            return Decoded(None, "skipped", name, "bom", 0, "encoding_conflict")
        return Decoded(text, "indexed", name, "bom", int(name != "UTF-8"))
    if b"\0" in data[:SNIFF]:
        raise NotText
    if said:
        name = canonical(said)
        try:
            text = strict(data, said)
        except LookupError:
            return Decoded(None, "skipped", name, "declaration", 0, "transcoder_unavailable")
        if text is None:
            return Decoded(None, "skipped", name, "declaration", 0, "conversion_failed")
        return Decoded(text, "indexed", name, "declaration", int(name != "UTF-8"))
    text = strict(data, "UTF-8")
    if text is not None:
        return Decoded(text, "indexed", "UTF-8", "utf8")
    if not fallbacks:
        return Decoded(None, "skipped", None, None, 0, "encoding_unknown")
    for name in fallbacks:
        try:
            text = strict(data, name)
        except LookupError:
            return Decoded(None, "skipped", canonical(name), "fallback", 0, "transcoder_unavailable")
        if text is not None:
            return Decoded(text, "indexed", canonical(name), "fallback", 1)
    return Decoded(None, "skipped", None, "fallback", 0, "conversion_failed")


def checked_fallbacks(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in (x.strip() for x in names):
        if not n:
            raise ValueError("encoding names must not be empty")
        if n.lower() in (x.lower() for x in out):
            raise ValueError(f"duplicate encoding {n!r}")
        out.append(n)
    return out
