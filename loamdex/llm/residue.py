"""Template residue, filler, error messages and notices that scripts are needed, in scanned pages.

Every cell of a page's lines, every run of neighbouring cells of one column, and every stretch of words inside a cell is a node if it begins and ends like a
sentence (cells and stretches of four words or more: if it does either; cells: also if they begin with a capital); none is left out for its words. Text is folded so that letters a scanner takes for each other fall together. Near-duplicates of
trusted wordings are found in partitioned SimHash tables, verified by Hamming distance and text similarity, and take over the label; this goes on
from the newly labelled ones until their connected components are exhausted. Marks that are residue beyond doubt (placeholders, filler, what programs
write, a word three times in a row) are trusted where they stand. Pages with a labelled node are reported.

A SimHash has 128 bits: the sign of each sum of a random sign per trigram. The signs of all windows of a page come from one running sum. It is cut into 8
keys of 16 bits, one for each table; a labelled node looks under its own key and the 16 with one other bit. So every pair of up to 15 differing bits
meets, and beyond it nearly all that are alike enough (the recall is in the README). What the labelled nodes look for is a bitmap of 8 x 65,536
bits whatever the data, against which a node is held where it stands; only nodes that hit it move.

A page that prints or quotes such words has them inside a longer sentence or in quotation marks; those nodes are unlike the wordings.
Pages with a null or empty text or a null doc_id hold no residue; repeated rows and repeated pages get equal answers; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import checkpointed

BITS, TABLES, KEY_BITS = 128, 8, 16
HAMMING, SIMILARITY = 30, 0.8  # both are asked of a near-duplicate
ROOT_SIMILARITY = 0.65  # to the trusted node a label comes from; else a chain of near-duplicates could end in printed text
WINDOW = 5  # cells that one wording may be broken into
LEAST, LEAST_INNER = 5, 18  # folded letters of a node, and of one inside a cell
LEAST_WORDS = 4  # words of a node that doesn't both begin and end like a sentence, and of a part of a wording
GRAM, TRIGRAM = 4, 3

# Wordings of unfilled templates, servers, viewers and browsers, in the languages of the pages.
WORDINGS = """
Please enable JavaScript to view this page.
JavaScript is required to use the page viewer.
You need to turn on cookies and scripts to continue reading.
You need to enable JavaScript to run this app.
This site requires JavaScript and cookies to be enabled.
Please turn on JavaScript and reload the page.
Loading page viewer... if nothing happens, allow scripts for this site.
This viewer does not work without scripts. Update your browser.
Your browser does not support embedded frames.
Your browser is out of date. Please update your browser.
Your browser does not support the video tag.
Cookies must be enabled to continue.
Your session has expired. Please sign in again.
Internal Server Error
500 Internal Server Error
404 Not Found
403 Forbidden
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
nginx/1.18
The page you requested could not be found on this server.
The requested URL was not found on this server.
The server encountered an internal error and was unable to complete your request.
Service temporarily unavailable. Please try again later.
Access denied. Reference no. 4
Access denied.
You do not have permission to access this page.
Too many requests from your address.
Connection to the page store timed out after 30 ms.
Error 17: image could not be loaded
The image could not be loaded (code 17).
This scan has not been released yet. Please come back later.
Back to the start page
Contact the site administrator.
Request ID 4
Sample article. Replace before printing.
This is dummy copy to show the column width.
This is placeholder text. Replace this text.
Filler text, filler text, filler text.
foo bar baz foo bar
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
Bitte aktivieren Sie Cookies, um fortzufahren.
Ihr Browser unterstützt keine Frames.
Diese Seite benötigt JavaScript.
Für den Seitenbetrachter müssen Skripte zugelassen sein.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Interner Serverfehler
Seite nicht gefunden (Fehler 404)
Das Bild konnte nicht geladen werden (Code 17).
Zugriff verweigert. Kennung 4
Zugriff verweigert.
Dies ist ein Blindtext und zeigt nur den Satzspiegel.
Zurück zur Startseite
Veuillez activer JavaScript pour afficher cette page.
Veuillez accepter les cookies pour continuer.
Cette visionneuse ne fonctionne pas sans JavaScript.
Votre navigateur ne prend pas en charge les cadres.
Votre session a expiré. Veuillez vous reconnecter.
Votre navigateur doit accepter les scripts et les cookies.
Erreur 404 : page introuvable
Erreur interne du serveur
L'image n'a pas pu être chargée (code 17).
Accès refusé. Référence 4
Accès refusé.
Ceci est un texte de remplissage pour la maquette.
Retour à la page d'accueil
Active JavaScript para ver esta página.
El visor necesita que su navegador permita scripts.
Su navegador no admite marcos.
Debe activar las cookies para continuar.
Error interno del servidor
Página no encontrada (error 404)
No se pudo cargar la imagen (código 17).
Acceso denegado. Referencia 4
Acceso denegado.
Su sesión ha caducado. Inicie sesión de nuevo.
Este es un texto de relleno para la maqueta.
Volver a la página de inicio
Oops! Something went wrong.
Your text goes here
Click here to edit this text.
Ad blocker detected. Please disable your ad blocker.
Segmentation fault (core dumped)
Command not found
No such file or directory
This page isn't working right now.
This site can't be reached.
Checking your browser before you continue.
Please verify that you are a human.
Please wait while the page is loading.
Sorry, the page you are looking for does not exist.
An unexpected error has occurred. Please try again later.
An error occurred while processing your request.
The connection was reset.
Unable to connect to the database.
Error establishing a database connection
This content is not available in your country.
You must be logged in to view this page.
This website uses cookies to improve your experience.
Accept all cookies
Page under construction. Check back soon.
Type your text here
Enter your headline here
Sample text for the column.
Object moved permanently
Bad request. Your browser sent a request that this server could not understand.
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Une erreur est survenue. Veuillez réessayer plus tard.
Se ha producido un error. Inténtelo de nuevo más tarde.
""".strip().split("\n")
#: The words of the usual filler text.
LOREM = set("""lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat
cupidatat non proident sunt culpa qui officia deserunt mollit anim laborum vestibulum vestib nullam ornare pellentesque pellent dictum semper laoreet sodales fermentum justo
praesent vitae tortor quam risus mauris integer cras donec morbi viverra egestas""".split())
#: Marks of an unfilled template. Names of people in braces and numbers in brackets, as printed in reports of sales, are none.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%=?[^%\n]+%>|\$\{\w+\}|\[\[[^\[\]\n]+\]\]|@@[\w ]{2,}@@|%[A-Z][A-Z0-9_]{2,}%|#[A-Z][A-Z0-9_]{3,}#|__[A-Z][A-Z0-9_]{2,}__|"
    r"&lt;\w{2,}&gt;|\{\d{1,2}\}|\[(?:[A-Z][A-Z0-9]{2,20})(?: [A-Z0-9]{2,20}){0,3}\]|\[[IlL1]n[sfr]\w{1,3}[trf]\b[^\[\]\n]{3,}\n?[^\[\]\n]*\]|\b[A-Z0-9][A-Z0-9 ]{2,30} [GC]OE[S5] HERE\b|"
    r"\bY[o0]ur [a-z][a-z ]{2,30} te[xz][tfrl] h[ecora]r[ecora]\b|\{\{[\w| ]{2,}\}?(?=\s|$)")
_PLACEHOLDER_MARKS, _PLACEHOLDER_WORDS = (*"{}%$[@#&<", "__", " HERE"), re.compile(r"[o0]ur [a-z ]+ te[xz]")
#: What programs write when they fail, by a text that every match holds.
_PROGRAMS = {
    "ack (m": r"\bTrace[bh]ack \(m", "Fatal": r"\bFatal error: \w", "/": r"/[a-z5]{2,6}/\w+/\w+\.(?:py|php|js|rb|java|go|p[hb]p)\b", "Error:": r"\b(?:[A-Z][a-z]+){1,3}Error:", "Exception:": r"\b(?:[A-Z][a-z]+){1,3}Exception:",
    "::": r"\b\w+::\w+\(\)", "SQLSTATE": r"\bSQLSTATE\b", "ORA-": r"\bORA-\d{3,}", "HTTP/": r"\bHTTP/\d", "ngin": r"\bnginx?z?[/ ]?\d", "errno": r"\berrno\b", "on line": r"\bon line \d+$",
}
PROGRAM = re.compile("|".join(_PROGRAMS.values()))
QUOTED = re.compile(r"[\"'“”„‘’«»‚](?=\w)|(?<=\w)[\"”“»«’‘']|[«»„“”]")
_MARKED, _NO_MARKS = re.compile(r"[\x01-\x05\r]"), str.maketrans("\r", "\n", "\x01\x02\x03\x04\x05")
_MARKS_OF_QUOTES = re.compile(r"[\"'“”„‘’«»‚]")
_INNER_APOSTROPHE = re.compile(r"(?<=\w)['’](?=\w)")
CELL = re.compile(r" {2,}\|? *| \| ?|\t+")
# where something may begin: a word that isn't written small; where it may end
_CAPITAL = re.compile(r"[^\sa-zß-ÿ\x01,.;:!?)-]")
_BEGIN = re.compile(rf"([ \n\x01])(?={_CAPITAL.pattern})")
_END = re.compile(r"([.!?:…])(?=[ \n\x01]|$)")


_FOLD = str.maketrans({**{c: "o" for c in "aeco0"}, **{c: "l" for c in "ilj1!tf"}, **{c: "n" for c in "nur"}, **{c: "b" for c in "h6b"}, **{c: "s" for c in "s5"},
                       **{c: "g" for c in "gq9"}, **{c: "v" for c in "vy"}, **{c: "x" for c in "xzk"}})
_NO_LETTERS = str.maketrans("", "", "".join(map(chr, range(128))).translate(str.maketrans("", "", "abcdefghijklmnopqrstuvwxyz# \n\x01\x02\x03\x04")))
_PAIRS = [("rn", "m"), ("ni", "m"), ("in", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ri", "n")]


_MARKS = re.compile("[\u0300-\u036f]+")


def plain(text: str) -> str:
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


def fold(text: str) -> str:
    """Letters that a scanner takes for each other fall together; digits on their own become #."""
    t = plain(text).replace("ß", "ss")
    for a, b in _PAIRS:
        t = t.replace(a, b)
    return t.translate(_FOLD)


_ID = re.compile(r"(?<=\bID )\w{8,12}\b")
# a word of eight characters and more with three digits and a letter, such as programs give to requests
_CODE = re.compile(r"(?<!\w)(?=(?:[a-z_]*\d){3})(?=\w*[a-z])\w{8,}(?!\w)")
_MIXED = re.compile(r"[0-9](?:(?=[a-z_])|(?<=[a-z_][0-9]))")
_DIGITS = re.compile(r"[0-9][0-9.,]*")


def _number(m: re.Match) -> str:
    """# for digits that stand alone, themselves for those inside a word."""
    s, (a, b) = m.string, m.span()
    within = a and (s[a - 1].isalnum() or s[a - 1] == "_") or b < len(s) and (s[b].isalnum() or s[b] == "_")
    return m[0] if within else "#"


def without_numbers(text: str) -> str:
    return _DIGITS.sub(_number, _CODE.sub("#", text) if _MIXED.search(text) else text)

_DROPPED = re.compile(r"[^a-z# \n\x01-\x04]+")


def _letters(text: str) -> str:
    t = fold(without_numbers(plain(_ID.sub("0", text) if "ID " in text else text))).translate(_NO_LETTERS)
    return t if t.isascii() else _DROPPED.sub("", t)


def folded(text: str) -> str:
    """The letters of a text as they are compared, with # for a number."""
    return _letters(_INNER_APOSTROPHE.sub("", text).replace("\n", " ")).replace(" ", "")


def prepared(text: str) -> str:
    """A page, folded, its words parted by spaces, with marks: \\x01 between cells of a line, \\x02 where something may begin, \\x03 where something may
    end, \\x04 for a quotation mark."""
    text = text.translate(_NO_MARKS) if _MARKED.search(text) else text
    if _MARKS_OF_QUOTES.search(text):
        text = QUOTED.sub("\x04", _INNER_APOSTROPHE.sub("", text))
    if "  " in text or "|" in text or "\t" in text:
        text = CELL.sub("\x01", text)
    text = ("\x02" if _CAPITAL.match(text) else "") + _BEGIN.sub("\\1\x02", text)
    return _letters(_END.sub("\\1\x03", text))


def columns(page: str) -> Iterator[str]:
    """The cells of each column one after another, parted by line ends. A line of one cell is in every column of the lines around; an empty line, or one
    without the column, ends it."""
    for block in re.split(r"\n\s*\n", page):
        if "\x01" not in block:
            yield block
            continue
        rows = [r for r in ([c for c in line.split("\x01") if c.strip(" \x02\x03\x04")] for line in block.split("\n")) if r]
        for col in range(max(map(len, rows), default=0)):
            run: list[str] = []
            for r in rows:
                if len(r) == 1 or col < len(r):
                    run.append(r[0] if len(r) == 1 else r[col])
                elif run:
                    yield "\n".join(run)
                    run = []
            if run:
                yield "\n".join(run)


def _words(text: str) -> list[str]:
    return re.findall(r"\S+", text)


def wording_parts(wording: str) -> set[str]:
    """A wording, folded, and its parts of at least four words and eighteen letters, as broken lines leave them."""
    ws = _words(wording)
    out = {folded(wording)}
    for sentence in re.split(r"(?<=[.!?])\s+", wording):
        if len(_words(sentence)) >= 2 and len(folded(sentence)) >= 14:
            out.add(folded(sentence))
    for i in range(len(ws)):
        for j in range(i + LEAST_WORDS, len(ws) + 1):
            if (i == 0 or j == len(ws)) and len(f := folded(" ".join(ws[i:j]))) >= LEAST_INNER:
                out.add(f)
    return {f for f in out if len(f) >= LEAST}


@cache
def catalogue() -> frozenset[str]:
    """The trusted nodes that every search starts from."""
    return frozenset(f for w in WORDINGS for f in wording_parts(w))


@cache
def most_words() -> int:
    """More words than any wording has, broken ones counted as two."""
    return max(len(w.split()) for w in WORDINGS) + 5


_LOREM = {fold(x) for x in LOREM}
_LONG_LOREM = {x for x in _LOREM if len(x) >= 5}
_NO_SIGNS = str.maketrans("", "", "#\x01\x02\x03\x04")


_ONLY_LETTERS = {i: " " for i in range(128) if not chr(i).islower()}


def repeated(text: str) -> str | None:
    """A word or a pair of words that stands three times in a row."""
    low = text.lower()
    ws = low.translate(_ONLY_LETTERS).split() if low.isascii() else re.findall(r"[a-z]+", low)
    if "xxx" in text or any(map(eq, ws, ws[1:])):
        for a, b, c in zip(ws, ws[1:], ws[2:]):
            if a == b == c and len(a) > 1 and a not in ("no", "ha", "oh", "la", "hear", "very", "ja", "tic", "bang", "hurrah"):
                return fold(a)
            if len(a) > 1 and {*a} | {*b} | {*c} == {"x"}:
                return "x"
    # three pairs in a row: four words one after another equal the ones two places on
    if not any(map(eq, ws, ws[2:])):
        return None
    same = [i for i, equal in enumerate(map(eq, ws, ws[2:])) if equal]
    return next((fold(ws[i] + ws[i + 1]) for i, j in zip(same, same[3:]) if j - i == 3), None)


def fillers(page: str) -> set[str]:
    """The cells of a prepared page, and runs of them, of four or more words, most of them of the usual filler text and none in quotation marks."""
    if sum(map(_LONG_LOREM.__contains__, page.translate(_NO_SIGNS).split())) < 2:
        return set()
    out = set()
    for cells in (column.split("\n") for column in columns(page)):
        words = [c.translate(_NO_SIGNS).split() for c in cells]
        for i in range(len(cells)):
            for j in range(i + 1, min(len(cells), i + WINDOW) + 1):
                ws = [w for c in words[i:j] for w in c if len(w) > 1]
                if len(ws) >= 4 and sum(map(_LOREM.__contains__, ws)) >= 0.7 * len(ws) and not any("\x04" in c for c in cells[i:j]):
                    out.add("filler" + "".join(ws))
    return out


def trusted_marks(text: str) -> set[str]:
    """What on a page is residue beyond doubt, each with its sort in front."""
    out: set[str] = set()
    if any(map(text.__contains__, _PLACEHOLDER_MARKS)) or "ur " in text and _PLACEHOLDER_WORDS.search(text):
        out |= {"placeholder" + folded(m[0]) for m in PLACEHOLDER.finditer(text) if not re.fullmatch(r"\{[A-Z][a-z]+\}|\[\d+\]", m[0])}
    if r := repeated(text):
        out.add("repeated" + r)
    if any(needle in text for needle in _PROGRAMS):
        out |= {"program" + folded(m[0]) for m in PROGRAM.finditer(text)}
    return out


def grams(s: str) -> frozenset[str]:
    """The character grams of a text as a bag: the second and further ones of a sort have their number behind them."""
    seen: dict[str, int] = {}
    out = []
    for i in range(max(1, len(s) - GRAM + 1)):
        g = s[i:i + GRAM]
        n = seen[g] = seen.get(g, 0) + 1
        out.append(g if n == 1 else f"{g}{n}")
    return frozenset(out)


def dice(x: frozenset[str], y: frozenset[str]) -> float:
    return 2 * len(x & y) / (len(x) + len(y))


def similar(a: str, b: str) -> float:
    """Dice coefficient of the bags of character grams."""
    return dice(grams(a), grams(b))


# ------------------------------------------------------------------------------------------------------------- hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers of 64 bits, mixed."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@cache
def _signs() -> np.ndarray:
    """Of each trigram of 28 letters, its 128 bits as bytes of 0 and 1, in 16 numbers: sums of up to 255 of them stay apart."""
    bits = np.unpackbits(_mixed(np.arange(2 * 28 ** TRIGRAM, dtype=np.uint64)).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits.view(np.uint64)


def _numbers(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(np.int64)
    return np.where(b == 35, 27, b - 96)


def simhashes(texts: list[str]) -> np.ndarray:
    """Two numbers of 64 bits for each folded text of 3 to 257 letters."""
    if not texts:
        return np.zeros((0, 2), dtype=np.int64)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.cumsum(size) - size
    c = _numbers("".join(texts))
    many = size - TRIGRAM + 1
    starts = np.cumsum(many) - many
    place = np.repeat(at - starts, many) + np.arange(many.sum())
    sums = np.add.reduceat(_signs()[(c[place] * 28 + c[place + 1]) * 28 + c[place + 2]], starts, axis=0).view(np.uint8)
    return np.packbits(2 * sums.astype(np.int16) > many[:, None], axis=1).view(np.int64)


def keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each hash in each table, with the table's number in front: table * 65536 + key."""
    return hashes.view(np.uint16).astype(np.int32) + (np.arange(TABLES, dtype=np.int32) << KEY_BITS)


_FLIPS = np.array([0, *(1 << k for k in range(KEY_BITS))], dtype=np.int32)


# -------------------------------------------------------------------------------------------------------------- nodes


GROUPS = 64


@cache
def _bounds() -> tuple[np.ndarray, int]:
    """Of each gram, which of 64 groups of trusted wordings have it, as 64 bytes of 0 and 1 in 8 numbers; and the most letters of a node that can be at
    ROOT_SIMILARITY to one of them: below 255, so that sums of those bytes stay apart."""
    known = np.zeros((28 ** GRAM, GROUPS), dtype=np.uint8)
    for i, w in enumerate(WORDINGS):
        for t in wording_parts(w):
            known[_gram_numbers(_numbers(t)), i % GROUPS] = 1
    longest = max(map(len, catalogue())) - GRAM + 1
    most = int(longest * (2 - ROOT_SIMILARITY) / ROOT_SIMILARITY) + GRAM - 1
    if most > 255:
        raise ValueError("a trusted wording is too long to be counted in bytes")
    return np.ascontiguousarray(known.view(np.uint64).T), most


def _gram_numbers(c: np.ndarray) -> np.ndarray:
    return ((c[:-3] * 28 + c[1:-2]) * 28 + c[2:-1]) * 28 + c[3:]


def spans_of(columns_of_pages: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All letters one after another, and each node's first letter, end and column.

    A node of a grams at ROOT_SIMILARITY to a trusted wording of b shares at least ROOT_SIMILARITY * (a + b) / 2 of them, so at least ROOT_SIMILARITY / (2 -
    ROOT_SIMILARITY) of its own are grams of one wording. Nodes with fewer in common with each group of wordings can take no label over, whatever
    chain leads to them, and aren't kept; nor are longer ones than any that could.
    """
    known, most = _bounds()
    b = np.frombuffer(("\x05".join(columns_of_pages) + "\x05").encode("ascii"), dtype=np.uint8)
    letter = b > 32
    text = b[letter].tobytes().decode("ascii")
    so_far = np.cumsum(letter)
    sep = np.flatnonzero(b < 32)
    kind, at = b[sep], so_far[sep]
    ends = np.flatnonzero((kind == 10) | (kind == 5))
    last, first = at[ends], np.concatenate([[0], at[ends][:-1]])
    column = np.cumsum(kind[ends] == 5) - (kind[ends] == 5)
    cell = np.searchsorted(ends, np.arange(len(sep)))
    has = lambda mark, where: np.bincount(cell[(kind == mark) & where], minlength=len(ends)) > 0
    opens, closes, quoted = has(2, at == first[cell]), has(3, at == last[cell]), has(4, True)
    full = last > first
    first, last, column, opens, closes, quoted = (x[full] for x in (first, last, column, opens, closes, quoted))
    n = len(first)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(s: np.ndarray, e: np.ndarray, own: np.ndarray) -> None:
        found.append((s, e, own))

    if n:
        new = np.concatenate([[True], column[1:] != column[:-1]])
        begins = new | opens | np.concatenate([[True], closes[:-1]])
        finishes = np.concatenate([new[1:], [True]]) | closes | np.concatenate([opens[1:], [True]])
        word = so_far[np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))] - 1
        of = np.searchsorted(last, word, side="right")
        words = np.bincount(of, minlength=n)
        # a cell that stands twice, one below the other, begins and ends there
        size = last - first
        for i in np.flatnonzero((size[1:] == size[:-1]) & ~new[1:]).tolist():
            if text[first[i]:last[i]] == text[first[i + 1]:last[i + 1]]:
                begins[i] = begins[i + 1] = finishes[i] = finishes[i + 1] = True
        quotes = np.concatenate([[0], np.cumsum(quoted)])
        for w in range(min(WINDOW, n)):
            s, e = first[:n - w], last[w:]
            ok = (column[:n - w] == column[w:]) & (quotes[w + 1:] == quotes[:n - w]) & (e - s >= LEAST) & (e - s <= most)
            ok &= begins[:n - w] & finishes[w:] if w else opens | (begins & finishes) | ((begins | finishes) & (words >= LEAST_WORDS))
            take(s[ok], e[ok], column[:n - w][ok])
        # stretches of words inside a cell, with one end at least where something may begin or end; columns that have run together leave no more
        mark = np.zeros(len(text) + 1, dtype=bool)
        mark[at[(kind == 2) | (kind == 3)]] = mark[first[begins]] = mark[last[finishes]] = True
        stop = np.concatenate([word[1:], [len(text)]])
        marked, stops = mark[word] & (begins[of] | (word > first[of])), mark[stop] & (finishes[of] | (stop < last[of]))
        plain_cell = ~quoted[of]
        for k in range(1, min(most_words(), len(word)) + 1):
            either = marked[:len(word) - k + 1] | stops[k - 1:] if k >= LEAST_WORDS else marked[:len(word) - k + 1] & stops[k - 1:]
            i = np.flatnonzero(either & plain_cell[:len(word) - k + 1] & (of[:len(word) - k + 1] == of[k - 1:]))
            s, e = word[i], stop[i + k - 1]
            ok = (e - s >= LEAST_INNER) & (e - s <= most) & ((s > first[of[i]]) | (e < last[of[i]]))
            take(s[ok], e[ok], column[of[i[ok]]])
    if not found:
        nothing = np.zeros(0, dtype=np.int64)
        return text, nothing, nothing, nothing
    s, e, own = (np.concatenate(x) for x in zip(*found))
    # sums of 8 numbers of 8 bytes at once; differences of running sums are right though those run over
    at_gram = _gram_numbers(_numbers(text))
    shared = np.zeros((len(s), 8), dtype=np.uint8)
    sums = np.zeros(len(at_gram) + 1, dtype=np.uint64)
    for lane in known:
        np.cumsum(lane[at_gram], out=sums[1:])
        np.maximum(shared, (sums[e - GRAM + 1] - sums[s]).view(np.uint8).reshape(-1, 8), out=shared)
    shared = shared.max(axis=1, initial=0)
    ok = shared >= ROOT_SIMILARITY / (2 - ROOT_SIMILARITY) * (e - s - GRAM + 1) - 1e-9
    return text, s[ok], e[ok], own[ok]


NODE = "node string, docs array<bigint>, h1 bigint, h2 bigint, trusted boolean"


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of the pages of a batch, each once, with the pages that have it. Pages are taken in small groups, whose running sums stay in the cache."""
    for pdf in batches:
        docs: dict[str, set[int]] = {}
        marks: dict[str, set[int]] = {}
        streams, owner, many = [], [], 0

        def flush() -> None:
            text, s, e, own = spans_of(streams)
            for a, b, c in zip(s.tolist(), e.tolist(), own.tolist()):
                docs.setdefault(text[a:b], set()).add(owner[c])
            streams.clear()
            owner.clear()

        for d, t in zip(pdf["doc_id"], pdf["text"]):
            if not t:
                continue
            page = prepared(t)
            for m in trusted_marks(t) | fillers(page):
                marks.setdefault(m, set()).add(d)
            for c in columns(page):
                streams.append(c)
                owner.append(d)
            many += len(page)
            if many > 60_000:
                flush()
                many = 0
        if streams:
            flush()
        h = np.concatenate([simhashes(list(docs)), np.zeros((len(marks), 2), dtype=np.int64)])
        yield pd.DataFrame({"node": [*docs, *marks], "docs": [sorted(x) for x in [*docs.values(), *marks.values()]], "h1": h[:, 0], "h2": h[:, 1], "trusted": [False] * len(docs) + [True] * len(marks)})


# ---------------------------------------------------------------------------------------------------------- near-duplicates


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h = simhashes(list(pdf["node"]))
        yield pd.DataFrame({"node": pdf["node"], "root": pdf["node"], "h1": h[:, 0], "h2": h[:, 1]})


def _probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where a labelled node looks: in each table under its key, and under those with one other bit."""
    for pdf in batches:
        own = keys(np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(dtype=np.int64)))
        yield pdf.rename(columns={"node": "label", "h1": "g1", "h2": "g2"}).assign(ats=list((own[:, :, None] ^ _FLIPS).reshape(len(pdf), -1)))


def _sought(batches: Iterator[pd.DataFrame], bitmap) -> Iterator[pd.DataFrame]:
    """The nodes that stand under a key that is looked for, once for each."""
    wanted = np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8)).astype(bool)
    for pdf in batches:
        own = keys(np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(dtype=np.int64)))
        row, _ = hit = np.nonzero(wanted[own])
        out = pdf.iloc[row].reset_index(drop=True)
        out.insert(0, "at", own[hit])
        yield out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes that are alike enough to the labelled node and to its root, with the similarity to the latter."""
    for pdf in batches:
        of = cache(grams)
        rows = []
        for node, label, root in set(zip(pdf["node"], pdf["label"], pdf["root"])):
            if dice(of(node), of(label)) >= SIMILARITY and (score := dice(of(node), of(root))) >= ROOT_SIMILARITY:
                rows.append((node, root, score))
        yield pd.DataFrame(rows, columns=["node", "root", "score"]).astype({"score": "float64"})


def _met(nodes: DataFrame, frontier: DataFrame) -> DataFrame:
    """node, root, h1, h2 of the nodes with a near-duplicate in the frontier, each once."""
    probes = frontier.mapInPandas(_probes, "label string, root string, g1 bigint, g2 bigint, ats array<int>").withColumn("at", F.explode("ats")).drop("ats")
    # at most TABLES * 65,536 numbers, however many nodes there are
    looked_for = probes.select("at").distinct().toPandas()["at"].to_numpy(dtype=np.int64)
    bits = np.zeros(TABLES << KEY_BITS, dtype=np.uint8)
    bits[looked_for] = 1
    bitmap = nodes.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    sought = nodes.select("node", "h1", "h2").mapInPandas(lambda batches: _sought(batches, bitmap), "at int, node string, h1 bigint, h2 bigint")
    differ = F.bit_count(F.col("h1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("h2").bitwiseXOR(F.col("g2")))
    longer, shorter = F.greatest(F.length("node"), F.length("label")) - (GRAM - 1), F.least(F.length("node"), F.length("label")) - (GRAM - 1)
    pairs = sought.join(probes, "at").where((differ <= HAMMING) & (longer * SIMILARITY <= shorter * (2 - SIMILARITY) + 1e-6)).select("node", "label", "root")
    fits = pairs.mapInPandas(_verified, "node string, root string, score double")
    return fits.groupBy("node").agg(F.max_by("root", F.struct("score", "root")).alias("root")).mapInPandas(_again, "node string, root string, h1 bigint, h2 bigint")


def _again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h = simhashes(list(pdf["node"]))
        yield pdf.assign(h1=h[:, 0], h2=h[:, 1])


def residue_nodes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes with the pages that have them, and the labelled ones that aren't trusted by themselves."""
    spark = documents.sparkSession
    pages = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = pages.mapInPandas(_nodes, NODE).persist()
    untrusted = nodes.where("not trusted")
    start = spark.createDataFrame([(f,) for f in sorted(catalogue())], "node string").mapInPandas(_hashed, "node string, root string, h1 bigint, h2 bigint")
    frontier, labelled = start, start.select("node").limit(0)
    while True:
        frontier = checkpointed(_met(untrusted, frontier).join(labelled, "node", "left_anti"))
        if frontier.isEmpty():
            return nodes, labelled
        labelled = labelled.unionByName(frontier.select("node"))


def residue_pages(documents: DataFrame) -> DataFrame:
    """doc_id of each page that holds residue, once."""
    nodes, labelled = residue_nodes(documents)
    return (nodes.where("trusted").select("docs").unionByName(nodes.where("not trusted").join(labelled, "node", "left_semi").select("docs"))
            .select(F.explode("docs").alias("doc_id")).distinct())


def clean_pages(documents: DataFrame) -> DataFrame:
    """The documents without the pages that hold residue."""
    return documents.join(residue_pages(documents), "doc_id", "left_anti")
