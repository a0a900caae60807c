"""Functions paired with their documentation.

Candidate comments near each function (the comments that end just above it, and in Python the docstring) are matched to the functions by a
maximum-weight bipartite assignment. The weight counts parameter tags that name the function's parameters, the function's name, the words
that are left as a description, and the distance. Links over a blank line or over code are implausible and thrown out, as are descriptions
with fewer than ``WORDS`` words left.

Functions are worked on in blocks of lines with lines of the neighbours around them, so a long file is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_LINES, blocks_with_context, current_files, indexed_lines

WORDS = 4
CONTEXT = 400  # lines of the neighbouring blocks; a longer comment is known as one by its end alone
REACH = 3  # blank lines over which a comment is still a candidate

HASH = {"python", "ruby", "shell", "elixir", "make", "dockerfile", "perl", "r", "yaml"}
DASH = {"lua", "haskell", "sql", "elm"}
SEMI = {"elisp", "scheme", "clojure", "lisp"}
# Marks of work to do, and directives to linters and compilers.
TASK = re.compile(r"(?i)\b(?:todo|fixme|xxx|hack|wip|tbd|bug|optimize|review)\b(?:\([^)]*\))?:?")
DIRECTIVE = re.compile(
    r"(?i)^[\s#/*;\-]*(?:@ts-[\w-]+|ts-[\w-]+|eslint[\w-]*|jshint|jslint|tslint:|prettier-ignore|istanbul|c8 ignore|go:[a-z]+|nolint\w*|NOLINT\w*|NOSONAR|"
    r"noqa|type:\s*ignore|pylint:|pragma|mypy:|flake8|fmt:|isort:|yapf|black:|nosec|rubocop:|shellcheck|clang-format|cppcheck|coverity|"
    r"frozen_string_literal|-\*-|vim?:|sorbet|typed:|@formatter|checkstyle|suppresswarnings|lint:|codespell|bandit|ruff:|pyright|@(?:override|deprecated)\b\s*$|region\b|endregion\b|\+build|//export)")
TAG = re.compile(r"(?i)^\s*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|type|rtype|raise|raises|tparam|yields?|see|since|author|version|deprecated|"
                 r"template|private|public|protected|internal|ignore|override|inheritdoc|memberof|static|class|function|method|async|module|property|prop|callback|typedef|"
                 r"in|out|brief(?=\s*$)|retval)\b|:(?:param|parameter|arg|argument|key|keyword|return|returns|rtype|type|raise|raises|except|exception|var|ivar|cvar|yields?|meta|vartype)\b|"
                 r"(?:args|arguments|parameters|params|returns?|raises|yields?|throws|attributes|examples?|notes?)\s*:?\s*$|(?:return|returns|param|params|throws)\s*[:\s]\s*[\w.]+\s*$|-{3,}\s*$)")
TAG_NAME = re.compile(r"(?:[@\\]|:)(?:param|arg|argument|parameter|keyword|key)\s*(?:\[[\w, ]+\]|\{[^}]*\})?\s+(?:[\w.\[\]]+\s+)*?([A-Za-z_]\w*)")
CODE = re.compile(r"(?x)^\s*(?:"
                  r"[\w.$\[\]\"']+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))(?:\.\w+\([^()]*\))*\s*[;{:]?"  # a call
                  r"|(?:(?:var|let|const|int|long|char|auto|final|local|my|export|static|double|float|bool|string|String)\s+[\w*:<>\[\] ]*)?[\w.$\[\]]+\s*(?::?=|[+\-*/|&]=)(?!=).*"  # an assignment
                  r"|(?:if|for|while|switch|elif|else\s+if|until|unless)\b.*(?:[:{]|\bthen|\bdo)\s*"
                  r"|(?:if|for|while|switch)\s*\(.*\).*"
                  r"|(?:return|throw|raise|yield|import|from|package|require|include|using|del|assert|break|continue|pass|print|goto)\b\s*[\w.\"'\[\](){},\s+\-*/]*;?"
                  r"|(?:else|try|finally|do|begin|end|fi|done|esac)\s*[:{;]?"
                  r"|(?:def|class|func|function|public|private|protected|static|interface|struct)\b.*[:{]\s*"
                  r"|\w+\s+[a-z]\w*_\w+\s+[\w\"'$]+"  # a command with an identifier
                  r"|[{}()\[\];,]+|.*[;{}]\s*|<\/?\w+[^>]*>\s*"
                  r")$")
CODE_WORDS = re.compile(r"^\s*(?:return|raise|throw|import|from|package|require|print|assert|yield|del|goto)\s+(?:[a-z]+\s+){3,}")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
OPEN = "([{"


def name_words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+", re.sub(r"[_\W\d]+", " ", name))
    return {p.lower() for p in parts} | {re.sub(r"[\W\d_]+", "", name).lower()}


def same_word(w: str, names: set[str]) -> bool:
    """Whether a word of a text is one of the name, inflected or not."""
    if w in names:
        return True
    for n in names:
        if len(n) > 2 and w.startswith(n[:-1]) and w in (n + "s", n + "es", n + "d", n + "ed", n + "ing", n[:-1] + "ing", n[:-1] + "ed", n[:-1] + "es", n[:-1] + "ies", n + n[-1] + "ing", n + n[-1] + "ed"):
            return True
    return False


def strip_marks(raw: list[str], kind: str) -> list[str]:
    """The lines of a comment without its marks. kind: hash, slash, dash, semi, block, doc."""
    out = []
    for t in raw:
        s = t.strip()
        if kind == "doc":
            s = re.sub(r"^[rRuUbB]{0,2}(?:\"{3}|'{3}|\"|')|(?:\"{3}|'{3}|\"|')\s*$", "", s)
        elif kind == "block":
            s = re.sub(r"\*+/\s*$", "", re.sub(r"^(?:/\*+!?|\*(?!/)|<!--|=begin|=end|\{-|--\[\[)\s?", "", s))
            s = re.sub(r"(?:-->|-\}|\]\])\s*$", "", s)
        else:
            s = re.sub(r"^(?:#+!?|//[/!]*|--+|;+)\s?", "", s)
        out.append(s.strip())
    return out


def description(lines: list[str], name: str) -> tuple[str, int]:
    """The describing lines of a comment without its marks, and how many words are left in them."""
    kept, count, names, tagged = [], 0, name_words(name), False
    for s in lines:
        if not s:
            tagged = False
            continue
        if DIRECTIVE.match(s):
            continue
        if TAG.match(s):
            tagged = True
            continue
        bare = TASK.sub(" ", s)
        if (CODE.match(bare) and not CODE_WORDS.match(bare)) or re.fullmatch(r"\W*", bare):
            continue
        if tagged and s[:1].islower() and re.match(r"^[\w.*]+\s*(?:\([^)]*\))?\s*:", s):  # an entry of a list of parameters
            continue
        words = [w for w in WORD.findall(re.sub(r"\{@\w+[^}]*\}|https?://\S+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])|_", " ", bare)))]
        n = sum(not same_word(w.lower(), names) for w in words)
        kept.append(bare.strip())
        count += n
    return "\n".join(kept), count


def comment_kind(line: str, language: str | None) -> str | None:
    s = line.strip()
    if language in HASH or (language is None and s.startswith("#")):
        return "hash" if s.startswith("#") and not s.startswith("#!") else None
    if language in DASH:
        return "dash" if s.startswith("--") else None
    if language in SEMI:
        return "semi" if s.startswith(";") else None
    if s.startswith("//"):
        return "slash"
    return "one" if s.startswith("/*") and s.endswith("*/") and "*/" not in s[2:-2] else None


DECORATOR = re.compile(r"^\s*(?:@[\w.]+(?:\(.*\))?|#\[.*\]|\[[A-Z]\w*(?:\(.*\))?\]|template\s*<.*>|__attribute__\s*\(\(.*\)\))\s*$")


def block_start(ls: list[str], end: int) -> int | None:
    """Where the block comment starts whose last line is ``end``; None if no such comment ends there."""
    s = ls[end].strip()
    if not s.endswith("*/"):
        return None
    for i in range(end, -1, -1):
        t = ls[i]
        if (j := t.rfind("/*")) >= 0 and not (i == end and "*/" in t[j:].rstrip()[:-2]):
            return i if not t[:j].strip() else None
        if i < end and "*/" in t:
            return None
    return 0  # it starts before the lines at hand


def comments_above(ls: list[str], at: int, language: str | None) -> list[dict]:
    """The comments that end above line index ``at``: nearest first, each with its lines and what lies between."""
    out, i, blanks, code = [], at - 1, 0, False
    while i >= 0 and blanks <= REACH:
        s = ls[i].strip()
        if not s:
            blanks += 1
            i -= 1
            continue
        if DECORATOR.match(ls[i]) or (comment_kind(ls[i], language) and DIRECTIVE.match(s)):
            if blanks:
                break
            i -= 1
            continue
        if s in (")", "])", "})") and language == "python" and (k := _decorator_start(ls, i)) is not None and not blanks:
            i = k - 1
            continue
        kind = comment_kind(ls[i], language)
        if language == "ruby" and s == "=end":
            j = next((k for k in range(i - 1, -1, -1) if ls[k].startswith("=begin")), None)
            if j is None:
                break
            out.append({"first": j, "last": i, "kind": "block", "blanks": blanks})
            i, blanks = j - 1, blanks
            break
        if kind in ("hash", "slash", "dash", "semi"):
            j = i
            while j > 0 and comment_kind(ls[j - 1], language) == kind:
                j -= 1
            out.append({"first": j, "last": i, "kind": kind, "blanks": blanks})
            i = j - 1
        elif language not in HASH and (j := block_start(ls, i)) is not None:
            out.append({"first": j, "last": i, "kind": "block", "blanks": blanks})
            i = j - 1
        else:
            break
        if blanks:
            break
    return out


def _decorator_start(ls: list[str], end: int) -> int | None:
    for i in range(end - 1, -1, -1):
        if not ls[i].strip():
            return None
        if ls[i].lstrip().startswith("@"):
            return i
    return None


def signature_end(ls: list[str], at: int, language: str | None) -> int:
    """The last line of a definition's head: where its brackets are closed again."""
    depth = 0
    for i in range(at, len(ls)):
        t = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*$" if language == "python" else r"\"(?:\\.|[^\"\\])*\"|//.*$", "", ls[i])
        depth += sum(t.count(c) for c in "([") - sum(t.count(c) for c in ")]")
        if depth <= 0 and (language != "python" or t.rstrip().endswith(":") or re.search(r":\s*\S", t.split(")")[-1])):
            return i
    return at


def docstring(ls: list[str], at: int) -> dict | None:
    end = signature_end(ls, at, "python")
    tail = re.search(r"\)[^:]*:\s*(\S.*)$", ls[end])
    i = end
    if tail and not tail[1].startswith("#"):
        ls = ls[:end] + [tail[1]] + ls[end + 1:]
    else:
        i = end + 1
        while i < len(ls) and (not ls[i].strip() or ls[i].lstrip().startswith("#")):
            i += 1
        if i >= len(ls):
            return None
    m = re.match(r"\s*(?:[rRuU]?)(\"{3}|'{3}|\"|')", ls[i])
    if not m or re.match(r"\s*[rRuU]?(?:\"\"|'')(?![\"'])", ls[i]):
        return None
    q, rest = m[1], ls[i][m.end():]
    if len(q) == 1:
        return {"first": i, "last": i, "kind": "doc", "blanks": 0} if re.search(rf"(?<!\\){q}\s*(?:#.*)?$", rest) and rest.count(q) == 1 else None
    j = i
    while q not in rest:
        j += 1
        if j >= len(ls):
            break
        rest = ls[j]
    return {"first": i, "last": min(j, len(ls) - 1), "kind": "doc", "blanks": 0, "raw": ls[i:j + 1]}


def parameters(ls: list[str], at: int, language: str | None) -> set[str]:
    text = " ".join(ls[at:signature_end(ls, at, language) + 1])
    m = re.search(r"\((.*)\)", text)
    return set(re.findall(r"[A-Za-z_]\w*", m[1])) if m else set()


def body_end(ls: list[str], at: int, language: str | None) -> int | None:
    """The last line of a function by its indentation; None if it isn't in the lines at hand."""
    end, own = signature_end(ls, at, language), len(ls[at]) - len(ls[at].lstrip())
    last = end
    for i in range(end + 1, len(ls)):
        t = ls[i]
        if not t.strip():
            continue
        if len(t) - len(t.lstrip()) <= own:
            if i == end + 1 and t.strip().startswith("{"):
                last = i
                continue
            return i if re.match(r"\s*(?:\}|end\b|\)|fi\b|done\b)", t) and language != "python" else last
        last = i
    return None


def assign(weights: dict[tuple[int, int], float]) -> dict[int, int]:
    """Maximum-weight matching of functions (left) to comments (right): the Hungarian method with potentials on each connected part of the
    graph, whose size is that of a few neighbouring functions."""
    by_left: dict[int, list[int]] = {}
    by_right: dict[int, list[int]] = {}
    for a, b in weights:
        by_left.setdefault(a, []).append(b)
        by_right.setdefault(b, []).append(a)
    done, out = set(), {}
    for a0 in by_left:
        if a0 in done:
            continue
        lefts, rights, todo = [], [], [a0]
        done.add(a0)
        seen_r: set[int] = set()
        while todo:
            a = todo.pop()
            lefts.append(a)
            for b in by_left[a]:
                if b not in seen_r:
                    seen_r.add(b)
                    rights.append(b)
                    for a2 in by_right[b]:
                        if a2 not in done:
                            done.add(a2)
                            todo.append(a2)
        if len(lefts) == 1:
            out[a0] = max(rights, key=lambda b: weights[a0, b])
            continue
        n, m = len(lefts), len(rights) + len(lefts)  # a dummy partner for each function
        cost = [[-weights.get((a, b), -1e6) for b in rights] + [0.0] * len(lefts) for a in lefts]
        u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
        for i in range(1, n + 1):
            p[0], j0 = i, 0
            least, used = [float("inf")] * (m + 1), [False] * (m + 1)
            while True:
                used[j0] = True
                i0, delta, j1 = p[j0], float("inf"), 0
                for j in range(1, m + 1):
                    if not used[j]:
                        cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                        if cur < least[j]:
                            least[j], way[j] = cur, j0
                        if least[j] < delta:
                            delta, j1 = least[j], j
                for j in range(m + 1):
                    if used[j]:
                        u[p[j]] += delta
                        v[j] -= delta
                    else:
                        least[j] -= delta
                j0 = j1
                if not p[j0]:
                    break
            while j0:
                p[j0], j0 = p[way[j0]], way[j0]
        for j in range(1, len(rights) + 1):
            if p[j] and (lefts[p[j] - 1], rights[j - 1]) in weights:
                out[lefts[p[j] - 1]] = rights[j - 1]
    return out


def pair(ls: list[str], functions: list[tuple[int, str, str]], language: str | None) -> list[tuple[int, str, str, str, int | None]]:
    """For functions (line index, name, signature): (index, name, signature, description, last body line) of each with real documentation."""
    comments: dict[tuple[int, str], int] = {}
    found: list[dict] = []
    weights: dict[tuple[int, int], float] = {}
    plausible: set[tuple[int, int]] = set()
    for k, (at, name, _) in enumerate(functions):
        if not 0 <= at < len(ls):
            continue
        near = comments_above(ls, at, language)
        if language == "python" and (d := docstring(ls, at)):
            near.append(d)
        params: set[str] | None = None
        for c in near:
            key = (c["first"], c["kind"])
            if key not in comments:
                comments[key] = len(found)
                found.append(c | {"lines": strip_marks(c.get("raw") or ls[c["first"]:c["last"] + 1], c["kind"])})
            j = comments[key]
            text, words = description(found[j]["lines"], name)
            tags = set(TAG_NAME.findall("\n".join(found[j]["lines"])))
            if tags:
                params = parameters(ls, at, language) if params is None else params
            weights[k, j] = (10 * (not c["blanks"]) + 8 * (words >= WORDS) + 2 * len(tags & (params or set())) + (name in "\n".join(found[j]["lines"])) + min(words, 20) / 20
                             - 0.01 * abs(at - (c["last"] if c["last"] < at else c["first"])))
            if not c["blanks"] and words >= WORDS:
                plausible.add((k, j))
    out = []
    # the definitions of one line stand for one function
    links = assign(weights)
    taken = {}
    for k, j in links.items():
        if (k, j) in plausible:
            taken[functions[k][0]] = (k, j)
    for k, (at, name, signature) in enumerate(functions):
        if at in taken and (taken[at][0] == k or functions[taken[at][0]][1] != name):
            text, words = description(found[taken[at][1]]["lines"], name)
            if words >= WORDS:
                out.append((at, name, signature, text, body_end(ls, at, language)))
    return out


def _pair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, first, before, own, after, mb, ma, language, symbols in zip(*(pdf[c] for c in ("file_id", "first_line", "before", "own", "after", "more_before", "more_after", "language", "symbols"))):
            head = before.split("\n") if mb else []
            ls = head + own.split("\n") + (after.split("\n") if ma else [])
            shift = first - len(head)  # the number of the first line at hand
            functions = sorted({(int(s["line"]) - shift, s["name"] or "", s["signature"] or "") for s in symbols})
            for at, name, signature, text, end in pair(ls, functions, language):
                rows.append((f, at + shift, name, signature, "\n".join(ls[at:(end if end is not None else at) + 1]), text, end is not None or not ma))
        yield pd.DataFrame(rows, columns=["file_id", "line", "name", "signature", "body", "description", "whole"]).astype({"file_id": "int64", "line": "int32", "whole": "bool"})


def documented(lines: DataFrame, files: DataFrame, symbols: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, line, name, signature, body, description: the functions and methods of indexed files that have real documentation.

    Null texts are empty lines, symbols without file, line or kind are left out, repeated rows count once, and of definitions on one line each name
    gives one row. Lines have to be numbered without gaps from 1, as the tables' are. A body that goes on past the neighbouring block's lines
    is put together from the lines themselves.
    """
    wanted = (symbols.where(F.col("kind").isin("function", "method") & F.col("file_id").isNotNull() & (F.col("line") >= 1))
              .select("file_id", F.floor((F.col("line") - 1) / block_lines).cast("int").alias("block"), F.struct(F.col("line").cast("int").alias("line"), "name", "signature").alias("s"))
              .groupBy("file_id", "block").agg(F.collect_set("s").alias("symbols")))
    # the files are joined to the symbols, so that the text moves once
    wanted = wanted.join(current_files(files).select("file_id", "language"), "file_id")
    blocks = blocks_with_context(lines, CONTEXT, CONTEXT, block_lines).join(wanted, ["file_id", "block"])
    found = blocks.mapInPandas(_pair_batches, "file_id bigint, line int, name string, signature string, body string, description string, whole boolean")
    return found


def pairs(lines: DataFrame, files: DataFrame, symbols: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Like documented(), with bodies that go on past the lines at hand completed."""
    found = documented(lines, files, symbols, block_lines).persist()
    rows = indexed_lines(lines, files).dropDuplicates(["file_id", "line"]).withColumnRenamed("line", "at").withColumnRenamed("text", "t")
    indent = lambda c: F.length(c) - F.length(F.ltrim(F.translate(c, "\t", " ")))
    cut = found.where("not whole").withColumn("n", F.size(F.split("body", "\n"))).withColumn("own", indent(F.element_at(F.split("body", "\n"), 1)))
    later = cut.join(rows, "file_id").where(F.col("at") > F.col("line"))
    ends = later.groupBy("file_id", "line", "name").agg(F.min(F.when((F.trim("t") != "") & (indent(F.col("t")) <= F.col("own")) & (F.col("at") > F.col("line") + CONTEXT), F.col("at"))).alias("end"))
    bodies = (later.join(ends, ["file_id", "line", "name"]).where(F.col("end").isNull() | (F.col("at") < F.col("end")) | (F.col("at") == F.col("end")) & F.col("t").rlike(r"^\s*(?:\}|end\b|fi\b|done\b)"))
              .groupBy("file_id", "line", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n").alias("rest")))
    return (found.join(bodies, ["file_id", "line", "name"], "left")
            .select("file_id", "line", "name", "signature", F.when(F.col("rest").isNull(), F.col("body")).otherwise(F.concat_ws("\n", F.element_at(F.split("body", "\n"), 1), "rest")).alias("body"), "description"))
