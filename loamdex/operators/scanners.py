"""Declaration scanners for the languages whose symbols need more than one line: Go and Ruby. They run on whole files in Arrow batches; a file is at most as
long as the index takes (a million bytes by default)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import CONTEXT_BYTES, SIGNATURE_BYTES

GO_SIGNATURE_LINES = 12
_GO = re.compile(r"(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])*'?|\n|[^\W\d]\w*|\d[\w.]*|[^\S\n]+|.")
_ENDS_STATEMENT = re.compile(r"[\w\"'`)\]}]$|^(?:\+\+|--)$")
_TRIM = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def cut(s: str, most: int) -> str:
    b = s.encode("utf-8")
    return s if len(b) <= most else b[:most].decode("utf-8", "ignore")


def assemble(lines: list[str], kind: str, name: str, line: int, end_line: int, column: int, signature: str) -> dict:
    return {"kind": kind, "name": name, "line": line, "end_line": end_line, "column": column, "signature": cut(signature.strip(_TRIM), SIGNATURE_BYTES),
            "context": cut("\n".join(lines[max(0, line - 3):line + 2]), CONTEXT_BYTES)}


class _GoTokens:
    """Tokens with line and byte column; a line end counts where the language would put a semicolon."""

    def __init__(self, lines: list[str]):
        self.items: list[tuple[str, int, int]] = []
        line, start, text, last = 1, 0, "\n".join(lines), ""
        for m in _GO.finditer(text):
            t = m[0]
            at = (line, len(text[start:m.start()].encode("utf-8")) + 1)
            if t == "\n" or t.startswith("//") or t.startswith("/*") and "\n" in t:
                if t != "\n" and t.startswith("//"):
                    continue
                if last and _ENDS_STATEMENT.search(last) and last not in _KEYWORDS_THAT_GO_ON:
                    self.items.append(("\n", *at))
                    last = ""
            elif not t.isspace() and not t.startswith("/*"):
                self.items.append((t, *at))
                last = t
            n = t.count("\n")
            if n:
                line, start = line + n, m.start() + t.rfind("\n") + 1
        self.items.append(("\n", line, 1))


_KEYWORDS_THAT_GO_ON = {"func", "type", "const", "var", "import", "package", "struct", "interface", "map", "chan", "if", "for", "switch", "select", "case", "default", "go", "defer", "range", "else"}


def _name(t: str) -> bool:
    return t[:1].isalpha() or t[:1] == "_"


def go_symbols(lines: list[str]) -> list[dict]:
    """Functions, methods, types, constants and variables of the outermost level, in order. A file that breaks off keeps what came before."""
    items = _GoTokens(lines).items
    if not any(t not in ("\n", ";") for t, _, _ in items):
        return []
    out: list[dict] = []
    i, n = 0, len(items)

    def close(j: int) -> int:
        """The index of the bracket that closes the one at j; the last index if none does."""
        depth = 0
        while j < n:
            t = items[j][0]
            depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
            if not depth:
                return j
            j += 1
        return n - 1

    def end_of(j: int, stop: str) -> int:
        """The index of the last token of a specification that starts at j: up to a line end or semicolon outside of brackets, or the closing bracket of its group."""
        while j < n and items[j][0] not in ("\n", ";") and items[j][0] != stop:
            j = close(j) + 1 if items[j][0] in ("(", "[", "{") else j + 1
        return j - 1

    def signed(first: int, last: int) -> str:
        a, b = items[first][1], items[min(last, n - 1)][1]
        return "\n".join(lines[a - 1:min(b, a + GO_SIGNATURE_LINES - 1)])

    def lines_end(k: int) -> int:
        t, line, _ = items[k]
        return min(line + t.count("\n"), len(lines))

    while i < n:
        t, line, _ = items[i]
        if t == "func":
            j, kind = i + 1, "function"
            if j < n and items[j][0] == "(":
                kind, j = "method", close(j) + 1
            if j < n and _name(items[j][0]):
                name, nl, nc = items[j]
                j += 1
                if j < n and items[j][0] == "[":
                    j = close(j) + 1
                head = j
                if j < n and items[j][0] == "(":
                    head = close(j)
                    j = head + 1
                    # results up to the body
                    while j < n and items[j][0] not in ("{", "\n", ";"):
                        head = close(j) if items[j][0] in ("(", "[") else j
                        if items[head][0] in ("interface", "struct") and head + 1 < n and items[head + 1][0] == "{":
                            head = close(head + 1)
                        j = head + 1
                last = close(j) if j < n and items[j][0] == "{" else head
                out.append(assemble(lines, kind, name, nl, lines_end(last), nc, signed(i, head)))
                i = last + 1
                continue
        elif t in ("type", "const", "var"):
            j = i + 1
            group = j < n and items[j][0] == "("
            stop = close(j) if group else None
            j = j + 1 if group else j
            while j < n and (stop is None or j < stop):
                while j < n and items[j][0] in ("\n", ";") and (stop is None or j < stop):
                    j += 1
                if j >= n or stop is not None and j >= stop or not _name(items[j][0]):
                    break
                last = end_of(j, ")" if group else "\0")
                if t == "type":
                    out.append(assemble(lines, "type", items[j][0], items[j][1], lines_end(last), items[j][2], signed(j, last)))
                else:
                    k, names = j, [j]
                    while k + 2 <= last and items[k + 1][0] == "," and _name(items[k + 2][0]):
                        k += 2
                        names.append(k)
                    out += [assemble(lines, "constant" if t == "const" else "variable", items[x][0], items[x][1], lines_end(last), items[x][2], signed(j, last)) for x in names if items[x][0] != "_"]
                j = last + 1
                if stop is None:
                    break
            i = (stop + 1) if stop is not None else max(j, i + 1)
            continue
        i = close(i) + 1 if t in ("(", "[", "{") else i + 1
    return out


_RUBY_OPEN = re.compile(r"^\s*(?:(class|module)\s+(<<\s*self|[A-Z]\w*(?:::\w+)*)|(?:(?:private|protected|public|module_function|memoize)\s+)?def\s+((?:self|[A-Z]\w*)\.)?([A-Za-z_]\w*[!?=]?|[+\-*/%<>=!~^&|\[\]]+)|([A-Z][A-Z0-9_]*)\s*=(?![=~>]))")
_RUBY_BLOCK = re.compile(r"^\s*(?:if|unless|while|until|case|for|begin)\b|(?:=|\breturn)\s*(?:if|unless|case|begin|while)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")
_RUBY_STRING = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|/(?:\\.|[^/\\\n])+/[a-z]*|#.*$")


def ruby_symbols(lines: list[str]) -> list[dict]:
    """Modules, classes, methods with their receivers and last lines, and constants."""
    out: list[dict] = []
    stack: list[dict | None] = []
    comment = False
    heredoc: str | None = None
    for no, raw in enumerate(lines, 1):
        if heredoc is not None:
            heredoc = None if raw.strip() == heredoc else heredoc
            continue
        if raw.startswith("=begin"):
            comment = True
        if comment:
            comment = not raw.startswith("=end")
            continue
        if raw.startswith("__END__"):
            break
        text = _RUBY_STRING.sub("''", raw)
        if h := re.search(r"<<[~-]?([A-Z_]{2,})\b", text):
            heredoc = h[1]
        m = _RUBY_OPEN.match(text)
        entry: dict | None = None
        opens = False
        if m:
            if m[1]:
                opens = not re.search(r"\bend\b\s*$", text)
                if not m[2].startswith("<<"):
                    column = len(raw[:m.start(2)].encode()) + 1
                    entry = assemble(lines, m[1], m[2], no, no, column, raw)
            elif m[4]:
                opens = not re.search(r"\bend\b\s*$|\)\s*=\s|^\s*def\s+[\w.]+[!?]?\s*=\s", text)
                start = m.start(3) if m[3] else m.start(4)
                inside = any(s and s.get("kind") == "self" for s in stack)
                name = ("self." if m[3] or inside else "") + m[4]
                entry = assemble(lines, "method", name, no, no, len(raw[:start].encode()) + 1, raw)
            elif m[5]:
                out.append(assemble(lines, "constant", m[5], no, no, len(raw[:m.start(5)].encode()) + 1, raw))
            if entry:
                out.append(entry)
        if opens:
            stack.append(entry if entry else {"kind": "self"})
        elif not (m and (m[1] or m[4])) and _RUBY_BLOCK.search(text) and not re.search(r"\bend\b\s*[.)\]]*\s*$", text):
            stack.append(None)
        if re.match(r"^\s*end\b", text) and stack:
            done = stack.pop()
            if done and "end_line" in done:
                done["end_line"] = no
    return out


def scanned_symbols(files: DataFrame) -> DataFrame:
    """file_id, path, language, kind, name, line, end_line, column, signature, context of rows with file_id, path, language (go or ruby) and lines."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "path", "language", "kind", "name", "line", "end_line", "column", "signature", "context"]
        for pdf in batches:
            rows = [{"file_id": f, "path": p, "language": g} | s for f, p, g, ls in zip(pdf["file_id"], pdf["path"], pdf["language"], pdf["lines"])
                    for s in (go_symbols if g == "go" else ruby_symbols)(list(ls))]
            yield pd.DataFrame(rows, columns=columns).astype({"file_id": "int64", "line": "int32", "end_line": "int32", "column": "int32"})

    return files.select("file_id", "path", "language", "lines").mapInPandas(
        scan, "file_id bigint, path string, language string, kind string, name string, line int, end_line int, column int, signature string, context string")
