"""Symbols of source lines by declaration forms: the first form of a language that a line has decides.

A form is what stands before a declared name (words that must be there, words that may be, runs of modifiers), the shape of the name, and what has
to follow it. Regular expressions are put together from these parts, so each language is described by how it declares things.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_BYTES, context, signature, truncate_bytes

#: White space and word boundaries are those of ASCII; Java's own shorthands know more characters.
SPACE = r"[\t\n\f\r ]"
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Words that look like a called or declared name in front of a bracket.
NOT_NAMES = ["catch", "else", "for", "if", "switch", "while", "with"]


class Form(NamedTuple):
    kind: str
    lead: str
    name: str
    tail: str
    guard: str = ""


def word(*choice: str) -> str:
    """One of some words, and space behind it."""
    return (choice[0] if len(choice) == 1 else f"(?:{'|'.join(choice)})") + SPACE + "+"


def maybe(*words: str) -> str:
    """Each of some words once or not at all, in this order."""
    return "".join(f"(?:{w}{SPACE}+)?" for w in words)


def either(*words: str) -> str:
    """One of some words or none."""
    return "(?:" + "|".join(w + SPACE + "+" for w in words) + ")?"


def run(*words: str) -> str:
    """Any of some words in any order and number, each with space behind it."""
    return "(?:" + "|".join(w + SPACE + "+" for w in words) + ")*"


def loose(words: str, least: str = "*") -> str:
    """A run of modifiers or space, in which modifiers may also touch; with + something has to be there."""
    return f"(?:{'|'.join(words.split())}|{SPACE}){least}"


def declares(kind: str, *lead: str, name: str, tail: str = EDGE, guard: str = "") -> Form:
    return Form(kind, SPACE + "*" + "".join(lead), name, tail, guard)


NAME = r"[A-Za-z_]\w*"
SCRIPT_NAME = r"[$A-Za-z_][\w$]*"
MARKED_NAME = NAME + "[!?]?"
LISP_NAME = r"[-A-Za-z0-9_+*/!?<>=]+"
SCOPED_NAME = r"[A-Za-z_:]\w*(?:::\w+)*"
TABLE_NAME = NAME + r"(?:[.:]\w+)*"
COMMAND_NAME = r"[A-Za-z_][\w.-]*"

OPENS = SPACE + r"*\("
PARAMETERS = OPENS + r"[^)]*\)"
BODY = rf"{SPACE}*\{{?{SPACE}*$"
#: A method of a language with types in front: no statement's end up to the bracket's close.
TYPED = OPENS + r"[^;]*\)" + BODY


def _before_bracket(characters: str) -> str:
    """What a line must be up to its first bracket for a form with a free run of types in front. The engine backtracks; a line that fails here would fail the
    form as well, but after trying every split of the run."""
    return f"(?=[{characters}]++\\()"


def _typed_members(modifiers: str, of_class: str = "") -> list[Form]:
    """Classes and methods of languages that put modifiers and a type before the name."""
    types = r"[\w<>\[\], ?]+" + SPACE + "+"
    return [declares("class", loose(of_class or modifiers, "+"), word("class"), name=NAME),
            declares("method", loose(modifiers, "+"), types, name=NAME, tail=TYPED, guard=_before_bracket(r"\w<>\[\], ?\t\n\f\r"))]


def _script(types: bool) -> list[Form]:
    """JavaScript, or TypeScript, which adds interfaces, abstract classes and annotated types."""
    arrow = rf"{SPACE}*[:=].*=>" if types else rf"{SPACE}*={SPACE}*(?:async{SPACE}*)?(?:\([^)]*\)|{SCRIPT_NAME}){SPACE}*=>"
    members = ["static", "async", "get", "set"]
    forms = [declares("function", maybe("export", "async"), word("function"), name=SCRIPT_NAME, tail=OPENS),
             declares("function", maybe("export"), word("const", "let", "var"), name=SCRIPT_NAME, tail=arrow),
             declares("class", maybe("export", *(["abstract"] if types else [])), word("class"), name=SCRIPT_NAME)]
    if types:
        forms.append(declares("interface", maybe("export"), word("interface"), name=SCRIPT_NAME))
        return [*forms, declares("method", run("public", "private", "protected", *members), name=SCRIPT_NAME, tail=PARAMETERS + SPACE + "*[:{]")]
    return [*forms, declares("method", run(*members), name=SCRIPT_NAME, tail=PARAMETERS + BODY)]


def _rust() -> list[Form]:
    public = rf"(?:pub(?:\([^)]*\))?{SPACE}+)?"
    named = {"type": "struct", "enum": "enum", "trait": "trait"}
    return [declares("macro", public, word("macro_rules!"), name=NAME), declares("function", public, maybe("async"), word("fn"), name=NAME, tail=SPACE + "*[<(]"),
            *(declares(kind, public, word(w), name=NAME) for kind, w in named.items())]


def _lisp(**words: str) -> list[Form]:
    return [declares(kind, r"\(", w, name=LISP_NAME) for kind, w in words.items()]


def _c_like(lead: str, name: str, after: str, before: str) -> list[Form]:
    return [declares("macro", f"#{SPACE}*", word("define"), name=NAME),
            declares("function", lead, SPACE + "+", name=name, tail=OPENS + r"[^;{}]*\)" + SPACE + "*" + after + r"(?:\{|$)", guard=_before_bracket(before))]


SPECS: dict[str, list[Form]] = {
    "python": [declares("function", maybe("async"), word("def"), name=NAME, tail=OPENS), declares("class", word("class"), name=NAME)],
    "ruby": [declares("method", word("def"), name=r"(?:self\.)?[A-Za-z_]\w*[!?=]?"), *(declares(w, word(w), name=SCOPED_NAME) for w in ("class", "module"))],
    "javascript": _script(types=False),
    "typescript": _script(types=True),
    # only where the scanner of declarations can't be used
    "go": [declares("function", word("func"), r"(?:\([^)]*\)" + SPACE + "*)?", name=NAME, tail=OPENS), declares("type", word("type"), name=NAME, tail=SPACE + "+(?:struct|interface)" + EDGE)],
    "rust": _rust(),
    "java": _typed_members("public protected private static final synchronized native abstract", of_class="public protected private abstract final static"),
    "csharp": _typed_members("public private protected internal static async virtual override sealed", of_class="public private protected internal static async virtual override sealed partial"),
    "kotlin": [declares("function", loose("public private protected internal open override suspend"), word("fun"), name=NAME, tail=OPENS),
               declares("class", either("data", "sealed", "open"), word("class"), name=NAME), declares("interface", word("interface"), name=NAME)],
    "swift": [declares("function", loose("public private internal open static class mutating"), word("func"), name=NAME, tail=OPENS),
              declares("type", loose("public private internal open"), word("class", "struct", "enum", "protocol"), name=NAME)],
    "php": [declares("function", loose("public protected private static"), word("function"), name=NAME, tail=OPENS), declares("class", either("abstract", "final"), word("class"), name=NAME)],
    "elixir": [declares("module", word("defmodule"), name=rf"{NAME}(?:\.{NAME})*", tail=SPACE + "+do" + EDGE), declares("macro", word("defmacrop?"), name=MARKED_NAME), declares("function", word("defp?"), name=MARKED_NAME)],
    "lua": [declares("function", maybe("local"), word("function"), name=TABLE_NAME, tail=OPENS), declares("function", name=TABLE_NAME, tail=rf"{SPACE}*={SPACE}*function" + OPENS)],
    "shell": [declares("function", maybe("function"), name=COMMAND_NAME, tail=SPACE + r"*\(\)" + SPACE + r"*\{?"), declares("function", word("function"), name=COMMAND_NAME)],
    "elisp": _lisp(function=word("(?:cl-)?defun"), macro=word("defmacro"), constant=word("def(?:var|custom|const)")),
    "clojure": _lisp(function=word("defn-?"), macro=word("defmacro"), constant=word("def(?:macro|record|protocol|multi)?")),
    "scheme": _lisp(function=word("define") + r"\(?"),
    "c": _c_like(r"(?:[A-Za-z_][\w\t\n\f\r *]+)", NAME, "", r"\w* \t\n\f\r"),
    "cpp": [*_c_like(rf"(?:template{SPACE}*<[^>]+>{SPACE}*)?(?:[\w:<>,~*&\t\n\f\r ]+)", r"[A-Za-z_~]\w*", rf"(?:const{SPACE}*)?(?:noexcept{SPACE}*)?(?:->{SPACE}*[^{{]+)?", r"^(;{}"),
            declares("type", word("class", "struct"), name=NAME)],
}


def pattern(form: Form) -> str:
    """A regular expression over a whole line with two groups, what is before the name and the name."""
    return f"(?s)^{form.guard}({form.lead})({form.name})(?-s:{form.tail}).*"


_BETWEEN = "\x01"


def match(language: Column, line: Column, specs: dict[str, list[Form]] | None = None) -> Column:
    """The kind, what is before the name, and the name of a line's declaration, parted by \\x01; null if its language has no form that the line has. Each form is
    tried once: what it finds replaces the line, and a line that is still itself doesn't have it. A name that no definition has makes the next form
    decide."""
    out: Column | None = None
    for lang, forms in (specs or SPECS).items():
        tried = F.array(*(F.regexp_replace(line, pattern(f), f"{f.kind}{_BETWEEN}$1{_BETWEEN}$2") for f in forms))
        named = F.filter(tried, lambda x: (x != line) & ~F.substring_index(x, _BETWEEN, -1).isin(*NOT_NAMES))
        value = F.get(named, F.lit(0))
        out = F.when(language == lang, value) if out is None else out.when(language == lang, value)
    return out


def _symbols(found: DataFrame, around: Column) -> DataFrame:
    """The rows of the symbols table from file_id, path, language, line, text and m, what match() gave. The column counts bytes from 1."""
    hit = found.where(F.col("m").isNotNull()).withColumn("s", F.split("m", _BETWEEN))
    return hit.select("file_id", "path", "language", F.col("s")[0].alias("kind"), F.col("s")[2].alias("name"), "line", F.col("line").alias("end_line"), (F.octet_length(F.col("s")[1]) + 1).alias("column"),
                      signature(F.col("text")).alias("signature"), around.alias("context"))


def pattern_symbols(files: DataFrame, specs: dict[str, list[Form]] | None = None) -> DataFrame:
    """file_id, path, language, kind, name, line, end_line, column, signature, context of rows with file_id, path, language and lines ARRAY<STRING>. A file
    of a language without forms has none."""
    each = files.select("file_id", "path", "language", "lines", F.posexplode("lines").alias("p", "text")).withColumn("line", (F.col("p") + 1).cast("int"))
    return _symbols(each.withColumn("m", match(F.col("language"), F.col("text"), specs)), context(F.col("lines"), F.col("line")))


def line_symbols(lines: DataFrame, files: DataFrame, block_lines: int = 1000) -> DataFrame:
    """Like pattern_symbols(), from rows of lines (file_id, line, text) and files (file_id, path, language), without a file ever being one row: the
    neighbours of a line come from a window over a block of lines with two lines of each block beside it."""
    block = F.floor((F.col("line") - 1) / block_lines)
    place = F.pmod(F.col("line") - 1, F.lit(block_lines))
    blocks = F.array_compact(F.array(block, F.when((place < 2) & (block > 0), block - 1), F.when(place >= block_lines - 2, block + 1)))
    known = files.where(F.col("language").isin(*SPECS)).select("file_id", "path", "language")
    spread = lines.select("file_id", "line", "text").join(known, "file_id").withColumn("m", match(F.col("language"), F.col("text"))).withColumn("own", block).withColumn("block", F.explode(blocks))
    w = Window.partitionBy("file_id", "block").orderBy("line")
    near = [F.lag("text", 2).over(w), F.lag("text", 1).over(w), F.col("text"), F.lead("text", 1).over(w), F.lead("text", 2).over(w)]
    windowed = spread.withColumn("around", F.array_join(F.array_compact(F.array(*near)), "\n")).where("own = block")
    return _symbols(windowed, truncate_bytes(F.col("around"), CONTEXT_BYTES))
