"""Elements of JSX, which are taken out of a script before its tokens are read, since their text has a lexis of its own."""

from __future__ import annotations

import re
from collections.abc import Callable

_PLACE = re.compile(r"(?:\A|[=(,:;!&|?{}\[\n]|=>|\breturn|\bdefault|\byield|\belse)\s*(?=<(?:[A-Za-z_$][\w$.:-]*[\s/>]|>))")
_HINT = re.compile(r"</[A-Za-z_$>]|/>")
_SKIPPED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ATTRIBUTE = re.compile(r"\s*([A-Za-z_$][\w$:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|(?=[{<])))?")
_TEXT = re.compile(r"[^<{}>]+")


class _Broken(ValueError):
    pass


def _braces(text: str, i: int, inner: Callable[[str], bool], spread: bool) -> int:
    """The end of an expression in braces that begins at i."""
    depth, j, parts, at = 0, i, [], i + 1
    while j < len(text):
        c = text[j]
        if c in "\"'`/" and (m := _SKIPPED.match(text, j)):
            j = m.end()
            continue
        if c == "<" and _PLACE.search(text, max(0, j - 12), j + 40) and (m := _TAG.match(text, j + 1) or text.startswith("<>", j)):
            try:
                end = _element(text, j, inner)
            except _Broken:
                j += 1
                continue
            parts.append(text[at:j] + "(0)")
            j = at = end
            continue
        depth += {"{": 1, "}": -1}.get(c, 0)
        j += 1
        if not depth:
            code = "".join(parts) + text[at:j - 1]
            bare = re.sub(r"/\*.*?\*/|//[^\n]*", "", code, flags=re.S)
            if not inner(bare):
                raise _Broken
            return j
    raise _Broken


def _element(text: str, i: int, inner: Callable[[str], bool]) -> int:
    """The end of the element that begins at i."""
    stack: list[str] = []
    j = i
    while True:
        if text.startswith("</", j):
            m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, j)
            if not m or not stack or stack.pop() != (m[1] or ""):
                raise _Broken
            j = m.end()
        elif text.startswith("<", j):
            m = _TAG.match(text, j + 1)
            name, j = (m[0], m.end()) if m else ("", j + 1)
            while True:
                if s := re.compile(r"\s*(/?>)").match(text, j):
                    if not m and s[0] != ">":
                        raise _Broken
                    j = s.end()
                    if s[1] == ">":
                        stack.append(name)
                    break
                if s := re.compile(r"\s*(?=\{)").match(text, j):
                    j = _braces(text, s.end(), inner, True)
                elif (s := _ATTRIBUTE.match(text, j)) and m:
                    j = s.end()
                    if s[2] == "":
                        j = _braces(text, j, inner, False) if text[j] == "{" else _element(text, j, inner)
                else:
                    raise _Broken
        elif text.startswith("{", j):
            j = _braces(text, j, inner, False)
        elif m := _TEXT.match(text, j):
            j = m.end()
        else:
            raise _Broken
        if not stack:
            return j


def without_elements(text: str, inner: Callable[[str], bool]) -> str | None:
    """The text with a bracketed number for each element. What looks like an element and isn't stays, for the grammar to judge."""
    if not _HINT.search(text):
        return text
    out, at, j = [], 0, 0
    while m := _PLACE.search(text, j):
        i = m.end()
        # not in a string or a comment of this line
        line = text.rfind("\n", 0, i) + 1
        if any(s.start() < i < s.end() for s in _SKIPPED.finditer(text, line)) if i - line < 500 else False:
            j = i + 1
            continue
        try:
            end = _element(text, i, inner)
        except (_Broken, RecursionError):
            j = i + 1
            continue
        out.append(text[at:i] + "(0)" + "\n" * 0)
        at = j = end
    return "".join(out) + text[at:] if out else text
