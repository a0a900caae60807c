"""Grammars of the supported languages as push-down automata over token classes.

A lexer, one compiled pattern per language, turns a text into tokens; an automaton takes one class at a time. Its states are interned and its
transitions kept, so that a token costs a dictionary look-up after the first time, however deep the nesting. The automata accept every
valid text of the constructs they know and reject what no reading of the grammar allows: open or crossing brackets, unclosed literals, operands
without an operator between, operators without operands, headers without their parts, statements where none can stand.

Python is left to the interpreter's own parser.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings

from . import ebnf, jsx
from .automata import Exhausted, Grammar

_WS = r"[ \t\r\f\v\u00a0\ufeff\u200b]+"
_STR = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_NUM = r"(?:0[xXbBoO][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[a-zA-Z_]*"
_ID = r"[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*"
_RUBY_NUM = r"(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[a-zA-Z_]*"
# what is put into a string, with braces in it
_INSERT = r"\{[^{}]*\}"
for _ in range(4):
    _INSERT = r"\{(?:[^{}]|" + _INSERT + r")*\}"

LEXERS = {
    "javascript": re.compile(rf"""(?xs)
        ((?:(?<=[=(,:;!&|?{{}}\[\n+~^%<>*-])|(?<=return)|(?<=typeof)|(?<=case)|(?<![\s\S]))[ \t]*/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*
        | \n | {_STR} | `(?:\\.|\$\{{(?:[^{{}}`]|\{{[^{{}}`]*\}}|`[^`]*`)*\}}|[^`\\])*` | {_NUM} | (?<![\s\S])\#![^\n]* | {_ID}
        | \.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\* | (?!//|/\*)[^\s\u200b\ufeff])
        | {_WS} | //[^\n]* | /\*.*?\*/ | (?:/\*)"""),
    "java": re.compile(rf"""(?xs) {_WS} | //[^\n]* | /\*.*?\*/ |
        (\n | \"\"\".*?\"\"\" | {_STR} | {_NUM} | @(?!interface\b)[^\W\d][\w.]* | {_ID}
        | \.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<< | .)"""),
    "c": re.compile(rf"""(?xs) {_WS} | //(?:\\\n|[^\n])* | /\*.*?\*/ | \\\r?\n | ^[ \t]*\#(?:/\*.*?\*/|\\\r?\n|[^\n])* |
        (\n | (?:L|u8|u|U)?(?:{_STR}) | {_NUM} | {_ID}
        | \.\.\.|->|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|>>=|<<|>>|:: | .)""", re.M),
    "go": re.compile(rf"""(?xs) {_WS} | //[^\n]* | (/\*.*?\*/ | \n | "(?:\\.|[^"\\\n])*" | `[^`]*` | '(?:\\[^\n]+?|[^'\\\n])' | {_NUM} | {_ID}
        | \.\.\.|:=|<-|&\^=|<<=|>>=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^ | .)"""),
    "ruby": re.compile(rf"""(?xs) {_WS} | \\\r?\n | (?:^=begin\b.*?^=end\b[^\n]*) | \#[^\n]* | ^__END__$.* |
        (\n | "(?:\\.|\#{_INSERT}|\#(?!\{{)|[^"\\\#])*" | '(?:\\.|[^'\\])*' | `(?:\\.|[^`\\])*`
        | <<[~-](["'`]?)[A-Za-z_]\w*\2|<<(["'`]?)[A-Z_]\w*\3(?=[ \t]*[\n,).;])
        | %[wWiIqQrs]?(?:\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\{{[^}}]*\}}|<[^>]*>|\|[^|]*\||![^!]*!)(?:[imxounse]{{1,4}}(?!\w))?
        | (?:(?<![\s\S])|(?<=[=(,!&|?{{\[\n~])|(?<=\bif)|(?<=\bwhen)|(?<=unless)|(?<=and)|(?<=or)|(?<=not)|(?<=[=(,!&|?{{\[~][ ])|(?<=\bif[ ])|(?<=when[ ])|(?<=unless[ ]))[ \t]*/(?![ =/])(?:\\[^\n]|[^/\\\n])+/[imxounse]*
        | :(?:"(?:\\.|[^"\\])*"|'[^']*'|[^\W\d]\w*[?!=]?(?!:)|\[\]=?|[+*/<>=~!%&|^-]{{1,3}}) | \?[A-Za-z](?!\w)
        | (?:\bdo|\{{)\s*\|[^|\n]*(?:\n[^|\n]*)?\| | [^\W\d]\w*[?!](?![=~])|[^\W\d]\w*:(?!:)(?=[\s,)]) | @@?[^\W\d]\w* | \$(?:\w+|[!@&~0-9*$?:"<>,./\;=]) | {_RUBY_NUM} | [^\W\d]\w*
        | \.\.\.|\*\*=|<=>|===|\|\|=|&&=|<<=|>>=|->|=>|==|!=|=~|!~|<=|>=|&&|\|\||\.\.|::|&\.|\+=|-=|\*=|/=|%=|\|=|&=|\^=|<<|>>|\*\* | .)""", re.M),
}
LEXERS["typescript"] = LEXERS["javascript"]

NUMBER = re.compile(r"(?i)(?:0x[\da-f_]+(?:\.[\da-f_]*)?(?:p[+-]?\d+)?|0b[01_]+|0o?[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:e[+-]?\d+)?)(?:n|[ulfdij]{0,3}|ri?)")

_CHARACTER = re.compile(r"'(?:\\[^\n]+?|[^\\'\n])'")
_MACRO = re.compile(r"(?:[A-Z][A-Z0-9_]*[a-z]{0,2}\d*|__\w+)")


class Rules:
    """A language by its grammar."""

    def __init__(self, language: str):
        self.language = language
        rules, start, reserved, words = {
            "javascript": (ebnf.SCRIPT, "program", ebnf.SCRIPT_RESERVED, ebnf.SCRIPT_WORDS), "typescript": (ebnf.SCRIPT + ebnf.TYPED, "program", ebnf.SCRIPT_RESERVED, ebnf.SCRIPT_WORDS + ebnf.TYPED_WORDS),
            "java": (ebnf.JAVA, "program", ebnf.JAVA_RESERVED, ebnf.JAVA_WORDS), "go": (ebnf.GO, "program", ebnf.GO_RESERVED, []), "c": (ebnf.C, "program", ebnf.C_RESERVED, []),
        }[language]
        extra = ["MACRO"] if language == "c" else []
        self.classes = {"ID": [*words, *extra], "NAME": ["ID", *words, *reserved], "PRIMITIVE": ["int", "long", "short", "byte", "char", "boolean", "float", "double"]}
        self.words = {w: w for w in [*reserved, *words]}
        self.rules, self.start, self.around = rules, start, ((), ())
        self.grammar = Grammar(rules, start, self.classes)
        self.known: dict[str, str] = {}

    def classify(self, t: str) -> str:
        """The class of a token; ERR for what no token is."""
        c = t[0]
        if t == "\n":
            return t
        if t in self.words:
            return t
        if self.language == "java" and c == "@" and len(t) > 1:
            return "AT"
        if t[:2] in ("#!", "/*") and len(t) > 2:
            return "" if self.language != "go" or "\n" not in t else "\n"
        if c.isalpha() or c in "_$":
            if self.language == "c" and t[-1] in "\"'":
                return "STR"
            return "MACRO" if self.language == "c" and _MACRO.fullmatch(t) else "ID"
        if c == "#" and len(t) > 1:
            return "PRIVATE"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return "NUM" if NUMBER.fullmatch(t) else "ERR"
        if len(t) > 1 and c in "\"'`":
            if c == "`":
                return "TPL" if self.language != "go" else "STR"
            if c == "'" and self.language in ("java", "go") and not _CHARACTER.fullmatch(t):
                return "ERR"
            return "STR"
        if len(t) > 2 and t.lstrip()[:1] == "/" and t not in ("/=", "/*"):
            return "STR"
        if c in "\"'`" or ord(c) > 127 or c in "\\#\0" or not c.isprintable() or t == "/*":
            return "ERR"
        return t

    def classes_of(self, text: str) -> list[str]:
        tokens = LEXERS[self.language].findall(text)
        if tokens and isinstance(tokens[0], tuple):
            tokens = [t[0] for t in tokens]
        if len(self.known) > 200_000:
            self.known.clear()
        known, classify = self.known, self.classify
        out = []
        for t in tokens:
            if t:
                k = known.get(t)
                if k is None:
                    k = known[t] = classify(t)
                if k:
                    out.append(k)
        return out

    def tokens(self, text: str) -> list[str]:
        """The classes of a text's tokens, its line ends as the language takes them."""
        classes = self.classes_of(text)
        if self.language in ("javascript", "typescript"):
            out = []
            for c in classes:
                if c == "\n":
                    c = "?NL"
                    if out and out[-1] == c:
                        continue
                elif c == "}" and out and out[-1] != "?NL":
                    out.append("?NL")
                out.append(c)
            return [*out, "?NL"]
        if self.language == "go":
            out = []
            for c in classes:
                if c != "\n":
                    out.append(c)
                elif out and (out[-1] in ("ID", "NUM", "STR", ")", "]", "}", "++", "--", "return", "break", "continue", "fallthrough")):
                    out.append("NL")
            return out
        if self.language == "c":
            out = []
            for c in classes:
                if c == "STR":
                    if not out or out[-1] != "STRS":
                        out.append("STRS")
                elif c != "\n":
                    out.append(c)
            return out
        return [c for c in classes if c != "\n"]

    def check(self, text: str) -> str | None:
        """None if the text is valid, else what is wrong."""
        if len(self.grammar.states) > 200_000:
            self.grammar = Grammar(self.rules, self.start, self.classes, *self.around)
        if self.language == "c" and (wrong := _conditions(text)):
            return wrong
        if self.language in ("javascript", "typescript"):
            text = jsx.without_elements(text, lambda inner: Rules.inner(self, inner))
            if text is None:
                return "element that isn't closed"
        tokens = self.tokens(text)
        try:
            at = self.grammar.run(tokens)
        except Exhausted:
            return EXHAUSTED
        if at is None:
            return None
        return "ends too early" if at < 0 or at >= len(tokens) - 1 and tokens[-1:] == ["?NL"] else f"unexpected {tokens[at][:30]!r}"

    def inner(self, text: str) -> bool:
        """Whether a text in the braces of an element is an expression, or nothing."""
        if not text.strip():
            return True
        return self.check(f"f({text}\n)") is None


_CONDITION = re.compile(r"(?m)^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b")


def _conditions(text: str) -> str | None:
    """Whether each #if of a C file has its #endif."""
    depth = 0
    if "#" in text:
        for m in _CONDITION.finditer(_C_COMMENT.sub(lambda m: "\n" * m[0].count("\n") if m[0][0] == "/" else m[0], text)):
            depth += {"if": 1, "ifdef": 1, "ifndef": 1, "endif": -1}.get(m[1], 0)
            if depth < 0 or m[1] in ("elif", "else") and not depth:
                return f"#{m[1]} without #if"
    return "#if without #endif" if depth else None


_C_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([A-Za-z_]\w*)\2")
#: Characters after which a / begins a regular expression in Ruby, beside those the lexer looks for.
_AT_START = re.compile(r"(?:^|[\n;])[ \t]*/(?![ =/*])(?:\\[^\n]|[^/\\\n])+/[imxounse]*", re.M)


_GOES_ON = set("+ - / % == != === =~ !~ <=> < > <= >= && || ^ << >> = += -= *= /= %= **= &= |= ^= <<= &&= ||= => , ( [ { . &. :: ? : ! and or not".split())

_RUBY_OPENING = ("if", "unless", "while", "until", "for", "begin", "case", "def", "class", "module", "do")
_BEHIND = {w: "M" + w.upper() for w in ("if", "unless", "while", "until", "rescue")}
_OPERANDS = set("ID CONST NUM QUOTED SYM WORDS ) ] } end self nil true false return break next redo retry super yield".split())


class RubyRules(Rules):
    """Ruby by its grammar. What stands in a heredoc is left out, its beginning is a string."""

    def __init__(self, language: str):
        self.language = language
        self.classes = {"ID": ["CONST"], "NAME": ["ID", "CONST", *ebnf.RUBY_RESERVED]}
        self.words = {w: w for w in ebnf.RUBY_RESERVED}
        self.rules, self.start, self.around = ebnf.RUBY, "program", (_RUBY_OPENING, ("end",))
        self.grammar = Grammar(self.rules, self.start, self.classes, *self.around)
        self.known = {}

    def classify(self, t: str) -> str:
        c = t[0]
        if t == "\n" or t in self.words:
            return t
        if len(t) > 2 and t.startswith("<<") and (t[2] in "~-\"'`" or t[2].isalpha() or t[2] == "_"):
            return "QUOTED"
        if t[-1] == "|" and len(t) > 2 and (c == "{" or t.startswith("do")):
            return "{ BAR" if c == "{" else "do BAR"
        if c == ":" and len(t) > 1 and t != "::":
            return "SYM"
        if c == "?" and len(t) == 2 and t[1].isalpha():
            return "QUOTED"
        if len(t) > 1 and (c in "\"'`" or c == "%" and t not in ("%=",)):
            return "WORDS" if c == "%" else "QUOTED"
        if t.lstrip()[:1] == "/" and len(t.lstrip()) > 2:
            return "WORDS"
        if c.isdigit():
            return "NUM" if NUMBER.fullmatch(t) else "ERR"
        if t[-1] == ":" and len(t) > 1 and (c.isalpha() or c == "_"):
            return "LABEL"
        if c in "@$" and len(t) > 1 or c.isalpha() or c == "_":
            return "CONST" if c.isupper() else "ID"
        if c in "\"'`\\#@$\0" or ord(c) > 127 or not c.isprintable():
            return "ERR"
        return t

    def tokens(self, text: str) -> list[str]:
        lexer, known = LEXERS["ruby"], self.known
        if len(known) > 200_000:
            known.clear()
        out: list[str] = []
        at = 0
        waiting = "<<" in text and _HEREDOC.search(text) is not None
        while True:
            again = False
            for m in lexer.finditer(text, at):
                t = m[1]
                if not t:
                    continue
                k = known.get(t)
                if k is None:
                    k = known[t] = self.classify(t)
                if waiting and k == "QUOTED" and t.startswith("<<"):
                    h = _HEREDOC.match(t)
                    line = text.find("\n", m.end())
                    end = re.compile(rf"(?m)^{'[ \\t]*' if h[1] else ''}{re.escape(h[3])}\r?$").search(text, line + 1) if line >= 0 else None
                    if end is None:
                        out.append("ERR")
                        return out
                    text, at, again = text[:line + 1] + text[min(end.end() + 1, len(text)):], m.end(), True
                if " " in k:
                    out += k.split(" ")
                else:
                    out.append(k)
                if again:
                    break
            if not again:
                return self.ended(out)

    @staticmethod
    def ended(classes: list[str]) -> list[str]:
        """A line end ends a statement, but not after an operator, nor before a call that goes on, nor at the end of brackets."""
        out: list[str] = []
        n, looping, words = len(classes), False, set(ebnf.RUBY_RESERVED)

        def endless(i: int) -> bool:
            """Whether an equals sign follows a method's name and its parameters on the same line."""
            j = i + 2 if classes[i + 2:i + 3] != ["."] else i + 4
            if classes[j:j + 1] == ["("]:
                depth = 0
                while j < n:
                    depth += {"(": 1, ")": -1}.get(classes[j], 0)
                    j += 1
                    if not depth:
                        break
            return classes[j:j + 1] == ["="] and classes[j + 1:j + 2] != ["("] or classes[j:j + 1] == ["="] and classes[j - 1:j] == [")"]

        for i, c in enumerate(classes):
            if c != "\n":
                last = out[-1] if out else ""
                if c in words and last in (".", "&.", "def", "DEFE") and c != "self":
                    c = "ID"  # a method's name
                elif c in _BEHIND and last in _OPERANDS:
                    c = _BEHIND[c]
                elif c == "do" and looping:
                    c, looping = "DOL", False
                elif c == "def" and endless(i):
                    c = "DEFE"
                if c in ("while", "until", "for"):
                    looping = True
                out.append(c)
                continue
            looping = False
            j = i + 1
            while j < n and classes[j] == "\n":
                j += 1
            last = out[-1] if out else ""
            if j < n and classes[j] in (".", "&.", ")", "]", "}") or last in ("NL", "?NL"):
                continue
            if last in _GOES_ON and not (len(out) > 1 and out[-2] in ("def", ".", ":")):
                continue
            out.append("?NL" if last in ("LABEL", "|", "*", "&", "**", "then", "do", "BAR") else "NL")
        return [*out, "?NL"]


class ShellError(Exception):
    pass


SH_WORD = re.compile(r"[^\s\"'`$\;&|<>(){}#]+|[{}#]")
SH_SPACE = re.compile(r"(?:[ \t\r]|\\\r?\n)+")
SH_OPEN = {"if": "if", "while": "while", "until": "while", "for": "for", "select": "for", "case": "case", "{": "{"}


def _sh_double(t: str, i: int) -> int:
    n = len(t)
    while i < n:
        c = t[i]
        if c == "\\":
            i += 2
        elif c == '"':
            return i + 1
        elif c == "$":
            i = _sh_dollar(t, i)
        elif c == "`":
            i = _sh_tick(t, i + 1)
        else:
            i += 1
    raise ShellError("unclosed quote")


def _sh_tick(t: str, i: int) -> int:
    while i < len(t):
        if t[i] == "\\":
            i += 2
        elif t[i] == "`":
            return i + 1
        else:
            i += 1
    raise ShellError("unclosed backquote")


def _sh_dollar(t: str, i: int) -> int:
    if t.startswith("$((", i):
        depth, j = 2, i + 3
        while j < len(t):
            if t[j] == "(":
                depth += 1
            elif t[j] == ")":
                depth -= 1
                if not depth:
                    return j + 1
            j += 1
        raise ShellError("unclosed arithmetic")
    if t.startswith("$(", i):
        return _sh_list(t, i + 2, ")")
    if t.startswith("${", i):
        j, depth = i + 2, 1
        while j < len(t):
            c = t[j]
            if c == "\\":
                j += 2
                continue
            if c == '"':
                j = _sh_double(t, j + 1)
                continue
            if c == "'" and False:
                continue
            if c == "$" and j + 1 < len(t) and t[j + 1] in "({":
                j = _sh_dollar(t, j)
                continue
            if c == "}":
                depth -= 1
                if not depth:
                    return j + 1
            elif c == "\n" and False:
                break
            j += 1
        raise ShellError("unclosed parameter")
    if t.startswith("$'", i):
        j = i + 2
        while j < len(t):
            if t[j] == "\\":
                j += 2
            elif t[j] == "'":
                return j + 1
            else:
                j += 1
        raise ShellError("unclosed quote")
    return i + 1


def _sh_word(t: str, i: int) -> tuple[int, str]:
    """End of the word that starts at i, and its text if it is without quotes and expansions."""
    n, s, plain = len(t), i, True
    while i < n:
        c = t[i]
        if c in " \t\r\n;&|<>()":
            if c in "(" and i > s and t[i - 1] in "=?*+@!" and (t[i - 1] == "=" or True):
                if t[i - 1] == "=":  # an array
                    i, plain = _sh_array(t, i + 1), False
                    continue
                depth, i = 1, i + 1
                while i < n and depth:
                    depth += (t[i] == "(") - (t[i] == ")")
                    i += 1
                continue
            break
        if c == "\\":
            i, plain = i + 2, False
        elif c == "'":
            j = t.find("'", i + 1)
            if j < 0:
                raise ShellError("unclosed quote")
            i, plain = j + 1, False
        elif c == '"':
            i, plain = _sh_double(t, i + 1), False
        elif c == "$":
            i, plain = _sh_dollar(t, i), False
        elif c == "`":
            i, plain = _sh_tick(t, i + 1), False
        else:
            i += 1
    return i, t[s:i] if plain else ""


def _sh_array(t: str, i: int) -> int:
    while i < len(t):
        c = t[i]
        if c in " \t\r\n":
            i += 1
        elif c == "#" and t[i - 1] in " \t\n":
            j = t.find("\n", i)
            i = len(t) if j < 0 else j
        elif c == ")":
            return i + 1
        elif c in ";&|<>(":
            raise ShellError("in an array")
        else:
            i, _ = _sh_word(t, i)
    raise ShellError("unclosed array")


def _sh_list(t: str, i: int, closer: str) -> int:
    """Parses commands up to the closer (``)`` or the end of the text); gives the index after it."""
    n = len(t)
    stack: list[list] = []  # [kind, part, commands in the part]
    at_command, count, here, joined = True, 0, [], False
    words_in = 0  # words of the command at hand

    def command() -> None:
        nonlocal count, joined
        count += 1
        joined = False

    while True:
        m = SH_SPACE.match(t, i)
        if m:
            i = m.end()
        if i >= n:
            break
        c = t[i]
        if c == "#":
            j = t.find("\n", i)
            i = n if j < 0 else j
            continue
        if c == "\n":
            i += 1
            for strip, word in here:
                while True:
                    j = t.find("\n", i)
                    row = t[i:] if j < 0 else t[i:j]
                    if (row.lstrip("\t") if strip else row).rstrip("\r") == word:
                        i = n if j < 0 else j + 1
                        break
                    if j < 0:
                        return n  # bash takes the end of the text as the end of the document
                    i = j + 1
            here = []
            if stack and stack[-1][0] == "for" and stack[-1][1] == "head":
                stack[-1][1] = "do?"
            at_command, words_in = True, 0
            continue
        if c == ")":
            if stack and stack[-1][0] == "case" and stack[-1][1] == "pattern":
                stack[-1][1] = "body"
                i, at_command, words_in = i + 1, True, 0
                continue
            if stack and stack[-1][0] == "(":
                if not count or joined:
                    raise ShellError("empty group")
                kind, part, outer = stack.pop()
                count, at_command, words_in = outer + 1, False, 1
                joined = False
                i += 1
                continue
            if closer == ")" and not stack:
                if joined:
                    raise ShellError("operator without a command")
                return i + 1
            raise ShellError("unexpected )")
        if c in ";&|":
            if t.startswith((";;", ";&"), i):
                if not stack or stack[-1][0] != "case" or stack[-1][1] not in ("body",):
                    raise ShellError("unexpected ;;")
                i += 3 if t.startswith(";;&", i) else 2
                stack[-1][1], at_command, words_in = "pattern", True, 0
                continue
            op = next(o for o in ("&&", "||", "|&", "&>>", "&>", ";&", ";", "&", "|") if t.startswith(o, i))
            if op in ("&>", "&>>"):
                i += len(op)
                m = SH_SPACE.match(t, i)
                i, _ = _sh_word(t, m.end() if m else i)
                continue
            if stack and stack[-1][1] == "pattern" and op == "|":
                i += 1
                continue
            if stack and stack[-1][0] == "for" and stack[-1][1] == "head":
                if op != ";":
                    raise ShellError("in a loop's head")
                stack[-1][1] = "do?"
                i, at_command, words_in = i + 1, True, 0
                continue
            if at_command and not words_in:
                raise ShellError(f"unexpected {op}")
            joined = op in ("&&", "||", "|", "|&")
            i, at_command, words_in = i + len(op), True, 0
            continue
        if c in "<>" or re.match(r"\d+[<>]", t[i:i + 4]):
            m = re.match(r"\d*(<<<|<<-?|<>|>>|>\||>&|<&|<|>)", t[i:i + 8])
            i += m.end()
            op = m[1]
            if t.startswith("(", i) and op in ("<", ">"):
                i = _sh_list(t, i + 1, ")")
                at_command, words_in = False, words_in + 1
                continue
            m = SH_SPACE.match(t, i)
            i = m.end() if m else i
            if t.startswith(("<(", ">("), i):
                i = _sh_list(t, i + 2, ")")
                continue
            j, w = _sh_word(t, i)
            if j == i:
                raise ShellError("redirection without a target")
            if op.startswith("<<") and op != "<<<":
                here.append((op == "<<-", re.sub(r"[\"'\\]", "", t[i:j])))
            i = j
            if at_command and not words_in:
                command()
                words_in = 1
            continue
        if c == "(":
            if stack and stack[-1][1] == "pattern":
                i += 1
                continue
            if t.startswith("((", i) and (at_command or stack and stack[-1][:2] == ["for", "name"]):
                j = t.find("))", i)
                if j < 0:
                    raise ShellError("unclosed arithmetic")
                i = j + 2
                command()
                at_command, words_in = False, 1
                if stack and stack[-1][0] == "for" and stack[-1][1] == "name":
                    stack[-1][1] = "do?"
                    at_command, words_in = True, 1
                continue
            if at_command:
                stack.append(["(", "", count])
                count, i, words_in = 0, i + 1, 0
                continue
            m = re.match(r"\([ \t]*\)", t[i:i + 40])
            if m and words_in == 1:
                i += m.end()
                m = re.match(r"(?:\s|#[^\n]*\n)*(?=[{(]|if\b|while\b|for\b|case\b)", t[i:])
                if not m:
                    raise ShellError("function without a body")
                i += m.end()
                at_command, words_in, count = True, 0, count - 1
                continue
            raise ShellError("unexpected (")
        j, w = _sh_word(t, i)
        if j == i:
            raise ShellError(f"unexpected {c}")
        top = stack[-1] if stack else None
        if top and top[0] == "for" and top[1] in ("name", "name2"):
            if top[1] == "name":
                top[1] = "name2"
            elif w == "in":
                top[1] = "head"
            elif w == "do":
                top[1] = "do?"
                continue
            else:
                raise ShellError("in a loop's head")
            i, at_command = j, False
            m = re.match(r"[ \t\r]*\n", t[i:])
            if top[1] == "name2" and (m or re.match(r"[ \t]*;", t[i:])):
                i += (m or re.match(r"[ \t]*;", t[i:])).end()
                top[1] = "do?" if not re.match(r"\s*in\b", t[i:]) else "name2"
                at_command, words_in = True, 0
            continue
        if top and top[0] == "for" and top[1] == "head":
            i = j
            continue
        if top and top[0] == "case" and top[1] == "word":
            top[1], i = "in", j
            continue
        if top and top[0] == "case" and top[1] == "in":
            if w != "in":
                raise ShellError("case without in")
            top[1], i, at_command, words_in = "pattern", j, True, 0
            continue
        if top and top[0] == "case" and top[1] == "pattern":
            if w == "esac":
                kind, part, outer = stack.pop()
                count, i, at_command, words_in, joined = outer + 1, j, False, 1, False
                continue
            i = j
            continue
        if not at_command:
            i, words_in = j, words_in + 1
            continue
        if w == "function":
            m = re.match(r"[ \t]+[^\s(){}]+[ \t]*(?:\([ \t]*\))?(?:\s)*(?=[{(])", t[j:])
            if not m:
                raise ShellError("function without a body")
            i = j + m.end()
            continue
        if w in SH_OPEN:
            kind = SH_OPEN[w]
            stack.append([kind, {"if": "cond", "while": "cond", "for": "name", "case": "word", "{": "body"}[kind], count])
            i, count, joined = j, 0, False
            at_command, words_in = kind not in ("for", "case"), 0
            continue
        if w in ("then", "elif", "else", "fi", "do", "done", "esac", "}"):
            if not top or joined:
                raise ShellError(f"unexpected {w}")
            kind, part, _ = top
            ok = {"then": kind == "if" and part in ("cond",) and count, "elif": kind == "if" and part == "then" and count, "else": kind == "if" and part == "then" and count,
                  "fi": kind == "if" and part in ("then", "else") and count, "do": kind == "while" and part == "cond" and count or kind == "for" and part == "do?",
                  "done": kind in ("while", "for") and part == "do" and count, "esac": kind == "case" and part in ("body", "pattern"), "}": kind == "{" and count}[w]
            if not ok:
                raise ShellError(f"unexpected {w}")
            i = j
            if w in ("fi", "done", "esac", "}"):
                _, _, outer = stack.pop()
                count, at_command, words_in = outer + 1, False, 1
                m = re.match(r"[ \t]*(?=[^\s;&|<>)#\d}])", t[i:])
                if m and not re.match(r"[ \t]*[<>]", t[i:]):
                    raise ShellError(f"a word after {w}")
            else:
                top[1] = {"then": "then", "elif": "cond", "else": "else", "do": "do"}[w]
                count, at_command, words_in = 0, True, 0
            continue
        if top and top[0] == "for" and top[1] == "do?":
            if w == "{":
                pass
            raise ShellError("loop without do")
        if w in ("!", "time", "coproc"):
            m = re.match(r"[ \t]+\w+(?=[ \t]+[{(])", t[j:j + 200]) if w == "coproc" else None
            i = j + (m.end() if m else 0)
            continue
        if w == "[[":
            m = re.search(r"(?:^|\s)\]\](?=[\s;&|)]|$)", t[j:])
            if not m:
                raise ShellError("unclosed [[")
            i = j + m.end()
            command()
            at_command, words_in = False, 1
            continue
        i = j
        command()
        words_in = 1
        at_command = bool(re.fullmatch(r"\w+\+?=.*|", w)) and bool(re.match(r"\w+(?:\[[^\]]*\])?\+?=", t[j - len(t[i:j]) if False else 0:0] or w)) if w else bool(re.match(r"\w+(?:\[[^\]\n]*\])?\+?=", t[_sh_start(t, j):j]))
        if at_command:
            words_in = 1
    if closer == ")":
        raise ShellError("unclosed (")
    if stack or joined:
        raise ShellError("ends too early")
    return n


def _sh_start(t: str, j: int) -> int:
    i = j
    while i > 0 and t[i - 1] not in " \t\n;&|(":
        i -= 1
    return i


class Shell:
    def check(self, text: str) -> str | None:
        try:
            _sh_list(text, 0, "")
        except ShellError as e:
            return str(e)
        except RecursionError:
            return EXHAUSTED
        return None


#: What is said of a text that is nested too deeply for a parser; it isn't called valid.
EXHAUSTED = "nested too deeply to be parsed"
PIECE = 1_000_000  # characters that the interpreter's parser gets at a time
_UNFINISHED = re.compile(r"never closed|unterminated|unexpected EOF|expected an indented block|EOF while|was expected|expected 'except'")


class Python:
    @staticmethod
    def parse(text: str) -> str | None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
            except SyntaxError as e:
                return (e.msg or "invalid syntax")[:80]
            except ValueError as e:  # a NUL
                return str(e)[:80]
            except (RecursionError, MemoryError):
                return EXHAUSTED
        return None

    def check(self, text: str) -> str | None:
        """Long texts are parsed in pieces cut at statements of the outermost level. A piece that is only unfinished, since the cut fell into a literal or a
        bracket, is joined with what follows it, twice as much each time; any other error stands, whatever follows."""
        text = text.lstrip("\ufeff")
        start, size = 0, PIECE
        while start < len(text):
            end = start + size
            if end < len(text):
                cut = anchor(text[end:end + PIECE])
                if cut is None:
                    size *= 2
                    continue
                end += cut
            error = self.parse(text[start:end])
            if error is None:
                start, size = min(end, len(text)), PIECE
            elif end >= len(text) or not _UNFINISHED.search(error):
                return error
            else:
                size = 2 * (end - start)
        return None


_MACHINES: dict[str, object] = {}
LANGUAGES = ("python", "javascript", "typescript", "go", "java", "ruby", "c", "shell")


#: A line on which a new statement of the outermost level starts.
ANCHOR = re.compile(r"(?m)^(?!(?:else|elif|elsif|except|finally|rescue|ensure|case|when|default|end|then|fi|done|do|esac|in|and|or|as|from)\b)[A-Za-z_$@][^\n]*$")
UNENDED = re.compile(r"(?:[\\,(\[{.+*/=&|<>?:-]|\b(?:and|or|not|in|return))\s*$")


def anchor(text: str) -> int | None:
    """Where the first line of a text stands that seems to start a statement of the outermost level."""
    for m in ANCHOR.finditer(text):
        before = text[:m.start()].rstrip().rpartition("\n")[2]
        if m.start() == 0 or not UNENDED.search(before) and not before.lstrip().startswith("@"):
            return m.start()
    return None


HEAD = 4_000  # characters whose tokens are tried first


def accepts(text: str, language: str) -> bool:
    """Whether a grammar takes a whole text. Most texts in another language break off within their first tokens; only the others are read to the end."""
    m = _machine(language)
    if isinstance(m, Rules) and len(text) > 2 * HEAD:
        head = text[:text.rfind("\n", 0, HEAD) + 1]
        tokens = m.tokens(head) if head else []
        try:
            at = m.grammar.run(tokens)
        except Exhausted:
            return False
        # a token that can't follow stays one whatever comes; only a literal or an element that was cut makes others of those near the end
        if at is not None and 0 <= at < len(tokens) // 2 and "<" not in head and "`" not in head:
            return False
    return check(text, language) is None


def _machine(language: str):
    m = _MACHINES.get(language)
    if m is None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
        m = _MACHINES[language] = {"python": Python, "shell": Shell}[language]() if language in ("python", "shell") else (RubyRules if language == "ruby" else Rules)(language)
    return m


def check(text: str, language: str, piece: bool = False) -> str | None:
    """None if the text is valid in the language, else what is wrong. An empty text is valid."""
    if not text.strip():
        return None
    m = _machine(language)
    if piece and language == "go":  # a later part of a file has no package clause
        text = "package p\n" + text
    return m.check(text)
