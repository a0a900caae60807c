"""Credentials embedded in source code.

A cheap JVM filter keeps the lines that could hold a secret at all; those go in Arrow batches through a scanner that

* joins literals put together on the line and decodes base64, hex, percent and backslash layers again and again,
* parses decoded bytes by the grammar of key containers (DER private keys, the OpenSSH container),
* applies the same rules to every layer; a hit inside a layer marks the whole enclosing literal.

Private keys over several lines are found from their markers: every line between them has to be a body line.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_lines, current_files, small

MASK = "********"
MAX_DEPTH = 100  # layers of encoding inside one another; each is shorter than the one around it, so this only keeps the interpreter's stack

# Shapes of tokens of public services, and tokens made of a short tag and a random part.
TOKEN = re.compile(r"""(?x)(?<![A-Za-z0-9])(?:
    (?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}
  | gh[pousr]_[A-Za-z0-9]{30,}  | github_pat_\w{30,}
  | glpat-[\w-]{20,}
  | xox[abeoprs]-[A-Za-z0-9-]{20,}
  | (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
  | AIza[\w-]{35}
  | ya29\.[\w-]{20,}
  | npm_[A-Za-z0-9]{30,} | pypi-[\w-]{40,} | hf_[A-Za-z0-9]{30,} | SG\.[\w-]{16,}\.[\w-]{30,}
  | sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}
  | eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}
  | [a-z]{2,5}-[0-9a-f]{32}(?![0-9A-Za-z])
  | [a-z]{2,5}\.[0-9a-f]{8}\.[A-Za-z0-9]{24,}
  )""")
TAGGED = re.compile(r"(?<![\w.])[a-z]{2,12}_(?:secret|token|key|pass):([^\s\"'`,;<>]{8,})")
#: Words that, at the end of a name, say that the value is a credential.
WORD = (r"(?:pass(?:w(?:or)?d|phrase|wort|code)?|pwd|pw|secret|token|cred(?:ential)?s?|bearer|auth(?:orization)?|"
        r"api[_.\- ]?key|apikey|key|kennwort|passwort|contrase(?:n|ñ)a|clave|mot[_.\- ]?de[_.\- ]?passe|motdepasse|sig(?:nature)?)")
NOT_KEY = re.compile(r"(?i)(?:public|primary|foreign|cache|sort|partition|hot|row|map|index|host|group|dict|lookup|unique|"
                     r"registry|config|nav|short|arrow|pub)[_.\- ]?key$")
NAME = re.compile(rf"(?i)(?:^|[a-z0-9_.\-])?{WORD}$")
ASSIGN = re.compile(r"""([A-Za-z_][\w.\-]*)\\?["']?\]?\s*(?::\s*(?:string|String|str|&str|&'static\s+str|char\s*\*)\s*=|:=|=>|=|:)\s*"""
                    r"""(?:(?:b|r|u|f|rb|@|L)?(["'`])((?:\\.|(?!\2).)*)\2|([^\s"'`;,(){}<>]+))""")
SUFFIXED = re.compile(r"""(\w+)\[\]\s*=\s*"((?:\\.|[^"\\])*)\"""")
ATTR = re.compile(r"""(?i)\b(?:key|name|id)\s*=\s*"([\w.\-]+)"\s+value\s*=\s*"([^"]*)\"""")
URL_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
URL_ARG = re.compile(rf"(?i)[?&;]([\w.\-]*{WORD})=([^&\s\"'#<>]+)")
HEADER = re.compile(r"(?i)\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/=_.\-:~!]{8,})")
HEADER_NAMED = re.compile(r"(?i)\b((?:X-)?[A-Za-z\-]*(?:key|token|auth(?:orization)?|secret))\s*:\s*([^\s\"'`,;]{8,})")
OPTION = re.compile(r"(?i)(?<![\w-])--?(?:pass(?:word|wd|phrase)?|pwd|token|secret|api-?key|auth|key)(?:=|\s+)(?:'([^']+)'|\"([^\"]+)\"|([^\s\"'`)]+))")
SHORT_P = re.compile(r"(?<=\s-p)([^\s\"'`)]{6,})")
USER_PASS = re.compile(r"(?<![\w-])(?:-u|--user)[ =][\w.\-]+:([^\s\"'`@]+)")
PROSE = re.compile(rf"(?i)\b{WORD}\b[`'\"]?(?:\s+(?:for|of|to|on|at|from|für|von|pour|de|para)\s+[^\s:]+)?\s*(?:is|was|are|lautet|ist|war|es|era|est|était|=|:)\s*[`'\"]?([^\s`'\"]+)")
USES = re.compile(r"(?i)(?:\b(?:uses|with|nutzt|utilise|usa)|(?<=\s)/)\s+[`'\"]?([^\s`'\"]+)")
LOGIN = re.compile(r"(?i)\b(?:log ?in|remember|account|user|anmeld|zugang|connexion|acceso)")
SQL = re.compile(r"(?i)\b(?:IDENTIFIED\s+(?:WITH\s+\w+\s+)?BY|PASSWORD)\s*=?\s*'([^']+)'|\bSET\s+[\w.]*(?:token|key|secret|password|pass)\w*\s+(?:TO|=)\s*'([^']+)'")
PAIR = re.compile(r"""(["'])([A-Za-z][\w.\-]{1,30})\1\s*,?\s*(["'])((?:(?!\3)[^\s\\]){8,64})\3""")
USER = re.compile(r"(?i)(?:(?:svc|srv|app|db|sys)[_.\-]?\w+|\w*(?:user|admin|operator|agent|bot)|root|ops|deployer?|auditor|kiosk|reporter|"
                  r"backup|guest|service|monitor|postgres|oracle|sa|maintainer|robot|runner|worker|owner|editor|viewer|tester)")
PIECES = re.compile(r"""(["'])((?:\\.|(?!\1).)*)\1(?:\s*(?:\+|\.|&|\|\|)?\s*(["'])((?:\\.|(?!\3).)*)\3)+""")
PIECE = re.compile(r"""(["'])((?:\\.|(?!\1).)*)\1""")
B64 = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}(?![A-Za-z0-9+/=])")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){12,}(?![0-9A-Za-z])")
PERCENT = re.compile(r"(?:[\w.\-~!*]*%[0-9A-Fa-f]{2}[\w.\-~!*]*)+")
ESCAPED = re.compile(r"(?:[\w./:@\-+=]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){6,}")
PEM_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_PUBLIC = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PRIVATE)[A-Z0-9 ]+-----(?:(?!-----END).)*(?:-----END [A-Z0-9 ]+-----|$)")
DATA_URI = re.compile(r"data:[\w/+.\-]+;base64,[A-Za-z0-9+/=]*")
SSH_PUBLIC = re.compile(r"\b(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-\w+) [A-Za-z0-9+/=]+")
# What stands where a secret was taken out or is still to come.
PLACEHOLDER = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?:example|placeholder|change[_\-]?me|redacted|replace(?:[_\-]?(?:me|this|with))?|dummy|sample|masked|hidden|removed|insert|fixme|foobar)\d{0,4}(?![A-Za-z0-9])|(?-i:EXAMPLE)|"
    r"your[_\-]|_here\b|^todo|^none$|^null$|^nil$|^test$|"
    r"^x{4,}|^[x\-]+$|^\*+|^\.+$|^•+|^-+$|^<.*>$|\$\{|\$\(|^\$\w|\{\{|^%\w+%$|^%\(|^vault:|^env:|^ref:|^secret:|^ssm:|^file:|^/run/|^@\w+@$|"
    r"^\{.*\}$|^\[.*\]$|^(.)\1{5,}$|getenv|environ|process\.env|^0+$")


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0.0


def plausible(v: str, named: bool) -> bool:
    """Whether a literal can be a secret: named says that its name or its place already says so."""
    if len(v) < 4 or PLACEHOLDER.search(v) or " " in v:
        return False
    if len(v) < 6:  # short ones have to be mixed to be more than a word or a number
        return named and all(any(map(kind, v)) for kind in (str.isalpha, str.isdigit, lambda c: not c.isalnum() and c not in "_.-/:()[]{}<>,;=+*&|\"'"))
    if v.isdigit():
        return named and len(v) >= 10
    digit, alpha = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    if not digit:
        mark = any(not c.isalnum() and c not in "_.-/:" for c in v)
        return named and alpha and ((mark and len(v) >= 8) or (len(v) >= 16 and not re.fullmatch(r"[A-Za-z]+(?:[_.\-/:][A-Za-z]+)*", v)) or
                                    (len(v) >= 20 and entropy(v) > 4 and not re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+", v)))
    if re.fullmatch(r"[a-z]+(?:_[a-z]+)+(?:_?\d{1,3})?|\d+(?:\.\d+)+|\d{4}-\d\d-\d\d.*|\d+(?:px|em|ms|s|kb|mb|gb)", v):
        return False
    if re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", v):
        return False
    if named:
        return alpha or len(v) >= 10
    if re.fullmatch(r"[A-Z]?[a-z]{3,}(?:[-_][a-z_]{3,}){2,}-\d{2,}", v) or re.fullmatch(r"[a-z]{8,}\d{3,}", v):
        return True
    return alpha and (any(not c.isalnum() and c not in "_.-/:" for c in v) or
                      (any(c.isupper() for c in v) and sum(c.isdigit() for c in v) >= 2 and not re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*\d{0,3}", v)))


def secret_name(name: str) -> bool:
    """Whether a name says that its value is a credential: its last word does, and it isn't another kind of key."""
    bare = re.sub(r"[_.\-]?\d+$", "", name.strip("_"))
    if NOT_KEY.search(bare):
        return False
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", bare)
    return bool(re.search(rf"(?i)(?:^|[_.\-]){WORD}$", split) or re.search(r"(?i)(?:passw(?:or)?d|passwd|secret|token|kennwort|contrase[nñ]a|motdepasse|apikey|password|"
                                                                          r"(?:bind|admin)pw|privatekey|signingkey|secretkey|accesskey|smtppass|dbpass)$", bare))


OPENSSH = b"openssh-key-v1\0"
PKCS7 = bytes.fromhex("2a864886f70d0107")


def openssh_private(b: bytes) -> bool:
    """The container of OpenSSH: cipher, derivation, its options, number of keys, that many public keys and the private part, each with its length, and no
    byte missing. A cipher needs a derivation, a key a known sort, and an open private part its two equal check numbers."""
    i = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal i
        n = int.from_bytes(b[i:i + 4], "big") if i + 4 <= len(b) else -1
        if n < 0 or i + 4 + n > len(b):
            return None
        i += 4 + n
        return b[i - n:i]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or (cipher == b"none") != (kdf == b"none") or i + 4 > len(b):
        return False
    n = int.from_bytes(b[i:i + 4], "big")
    i += 4
    public = [field() for _ in range(min(n, 1 + len(b) // 8))]
    private = field()
    if not public or not private or any(not p or not re.match(rb"\0\0\0[\x07-\x40](?:ssh-|ecdsa-|sk-)", p) for p in public):
        return False
    return len(private) % 8 == 0 and (cipher != b"none" or len(private) >= 16 and private[:4] == private[4:8])


#: The secret parts of a JSON web key.
JWK_KIND, JWK_PART = re.compile(r"[\"']kty[\"']\s*:"), re.compile(r"[\"'](?:d|k|p|q|dp|dq|qi)[\"']\s*:\s*[\"']([A-Za-z0-9_-]{20,})[\"']")


def der_private(b: bytes) -> bool:
    """PKCS#1, PKCS#8 or SEC 1 private keys by their grammar: SEQUENCE { INTEGER 0 or 1, INTEGER | SEQUENCE { OID } |
    OCTET STRING ... } whose lengths fit; PKCS#12: SEQUENCE { INTEGER 3, SEQUENCE { OID of PKCS#7 } }; and OpenSSH's own container."""
    if b.startswith(OPENSSH):
        return openssh_private(b)

    def head(i: int) -> tuple[int, int, int] | None:
        if i + 2 > len(b):
            return None
        tag, n, j = b[i], b[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k < 5 or j + k > len(b):
                return None
            n, j = int.from_bytes(b[j:j + k], "big"), j + k
        return tag, n, j

    top = head(0)
    if not top or top[0] != 0x30 or top[2] + top[1] > len(b) + 4 or top[1] < 24:
        return False
    version = head(top[2])
    if not version or version[0] != 2 or version[1] != 1 or b[version[2]:version[2] + 1] not in (b"\0", b"\1", b"\3"):
        return False
    third = head(version[2] + 1)
    if not third:
        return False
    if b[version[2]] == 3:
        oid = head(third[2]) if third[0] == 0x30 else None
        return bool(oid and oid[0] == 6 and b[oid[2]:oid[2] + oid[1]].startswith(PKCS7) and top[1] > 100)
    if third[0] == 0x30:
        oid = head(third[2])
        return bool(oid and oid[0] == 6)
    return third[0] == 4 and 16 <= third[1] <= 80 or third[0] == 2 and third[1] >= 32


def layers(token: str, kind: str) -> Iterator[bytes]:
    try:
        if kind == "b64":
            t = token.rstrip("=").replace("-", "+").replace("_", "/")
            yield base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
        elif kind == "hex":
            yield binascii.unhexlify(token)
        elif kind == "percent":
            yield unquote_to_bytes(token)
        else:
            yield re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([0-7]{3})",
                         lambda m: chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)), token).encode("utf-8", "surrogatepass")
    except (ValueError, binascii.Error):
        return


def text_of(b: bytes) -> str | None:
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 4 and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


def scan(text: str, depth: int = 0) -> list[tuple[int, int, str]]:
    """Spans (start, end, rule) of secrets in one line. Rule ``bare`` stands for an assignment of an unquoted value, which
    only counts in files where values stand without quotes; the caller knows the file."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    # what is public or no secret at all can't be found by any later rule
    blanked = text
    if "-----BEGIN" in text:
        for m in PEM_BEGIN.finditer(text):
            if e := PEM_END.search(text, m.end()):
                body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", text[m.end():e.start()])
                if len(body) >= 16:
                    out.append((m.end(), e.start(), "pem"))
        blanked = PEM_PUBLIC.sub(lambda m: " " * len(m[0]), blanked)
    if ";base64," in text:
        blanked = DATA_URI.sub(lambda m: " " * len(m[0]), blanked)
    if "ssh-" in text or "ecdsa-" in text:
        blanked = SSH_PUBLIC.sub(lambda m: " " * len(m[0]), blanked)
    for s, e, _ in out:
        blanked = blanked[:s] + " " * (e - s) + blanked[e:]
    if "<" in blanked and "value" in low:
        for m in ATTR.finditer(blanked):
            if secret_name(m[1]) and plausible(m[2], True):
                out.append((m.start(2), m.end(2), "attribute"))
        blanked = XML_NAME.sub(lambda m: " " * len(m[0]), blanked)
    text, n0 = blanked, len(out)
    worded = WORDED.search(text) is not None

    def add(s: int, e: int, rule: str, named: bool = True) -> None:
        v = text[s:e]
        if plausible(v, named):
            out.append((s, e, rule))

    for m in TOKEN.finditer(text):
        if not PLACEHOLDER.search(m[0]):
            out.append((m.start(), m.end(), "token"))
    for m in TAGGED.finditer(text):
        add(m.start(1), m.end(1), "tagged")
    if "kty" in text and JWK_KIND.search(text):
        out += [(m.start(1), m.end(1), "container") for m in JWK_PART.finditer(text)]
    # literals put together on the line
    if text.count('"') + text.count("'") >= 4:
        for m in PIECES.finditer(text):
            parts = list(PIECE.finditer(text, m.start(), m.end()))
            whole = "".join(p[2] for p in parts)
            if "," in text[m.start():m.end()] and any("," in text[a.end():b.start()] for a, b in zip(parts, parts[1:])):
                continue
            named = (a := re.search(r"([A-Za-z_][\w.\-]*)[\"']?\]?\s*(?::\s*\w+\s*=|:=|=>|=|:)\s*$", text[:m.start()])) and secret_name(a[1])
            if (named and plausible(whole, True)) or (len(parts) > 1 and depth < MAX_DEPTH and any(r != "bare" and (e - s) > max(len(p[2]) for p in parts) for s, e, r in scan(whole, depth + 1))):
                out += [(p.start(2), p.end(2), "joined") for p in parts if p[2]]
    for m in ASSIGN.finditer(text) if worded else ():
        if secret_name(m[1]):
            if m[2]:
                add(m.start(3), m.end(3), "assigned")
            else:
                add(m.start(4), m.end(4), "bare")
    for m in SUFFIXED.finditer(text) if worded else ():
        if secret_name(m[1]):
            add(m.start(2), m.end(2), "assigned")
    if "://" in text:
        for m in URL_USER.finditer(text):
            add(m.start(1), m.end(1), "url")
        for m in URL_ARG.finditer(text):
            if secret_name(m[1]):
                add(m.start(2), m.end(2), "url")
    if "basic" in low or "bearer" in low or "token" in low:
        for m in HEADER.finditer(text):
            if m[1].lower() == "basic":
                pair = next((text_of(b) for b in layers(m[2], "b64")), None)
                if pair and ":" in pair and plausible(pair.split(":", 1)[1], True):
                    out.append((m.start(2), m.end(2), "basic"))
            elif m[1].lower() == "bearer" or "authorization" in low:
                add(m.start(2), m.end(2), "bearer")
    if worded and ":" in text and re.search(r"(?i)-H\b|header|x-[a-z]", text):
        for m in HEADER_NAMED.finditer(text):
            add(m.start(2), m.end(2), "header")
    if worded and "-" in text:
        for m in OPTION.finditer(text):
            g = next(i for i in (1, 2, 3) if m[i] is not None)
            add(m.start(g), m.end(g), "option")
        if " -p" in text and "-u" in text:
            for m in SHORT_P.finditer(text):
                add(m.start(1), m.end(1), "option")
        for m in USER_PASS.finditer(text):
            add(m.start(1), m.end(1), "option")
    if "'" in text and ("by" in low or "password" in low or "set " in low):
        for m in SQL.finditer(text):
            g = 1 if m[1] is not None else 2
            add(m.start(g), m.end(g), "sql")
    for m in PROSE.finditer(text) if worded else ():
        e = m.end(1)
        if text[e - 1] in ".,;)" and not re.search(r"[#!+\d]$", text[m.start(1):e]):
            e = m.start(1) + len(m[1].rstrip(".,;)"))
        v = text[m.start(1):e]
        if any(c.isdigit() for c in v) and not re.search(r"[(\[{]", v) and plausible(v, False):
            out.append((m.start(1), e, "prose"))
    if worded and LOGIN.search(text):
        for m in USES.finditer(text):
            v = m[1].rstrip(",;)")
            if any(c.isdigit() for c in v) and "(" not in v and plausible(v, False) | (len(v) >= 12 and entropy(v) > 3.2 and plausible(v, True) and not re.fullmatch(r"[\w.\-/]+\.(?:\w{2,7})(?:/.*)?", v)):
                out.append((m.start(1), m.start(1) + len(v), "login"))
    for m in PAIR.finditer(text) if text.count('"') + text.count("'") >= 4 else ():
        if USER.fullmatch(m[2]) and any(c.isdigit() for c in m[4]):
            add(m.start(4), m.end(4), "pair", named=not re.fullmatch(r"[a-z_\d]+", m[4]))
    if depth < MAX_DEPTH:
        for rx, kind in ((B64, "b64"), (HEX, "hex"), (PERCENT, "percent"), (ESCAPED, "escaped")):
            if kind == "percent" and "%" not in text or kind == "escaped" and "\\" not in text:
                continue
            for m in rx.finditer(text):
                if any(s <= m.start() and m.end() <= e for s, e, _ in out[n0:]) or kind == "b64" and IDENTIFIER.fullmatch(m[0]):
                    continue
                for b in layers(m[0], kind):
                    if der_private(b):
                        out.append((m.start(), m.end(), "container"))
                    elif (inner := text_of(b)) and len(inner) < len(m[0]) and any(r not in ("bare", "prose", "login") or kind != "escaped" and r == "bare" for _, _, r in scan(inner, depth + 1)):
                        out.append((m.start(), m.end(), "decoded"))
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    for s, e in merged(spans)[::-1]:
        text = text[:s] + MASK + text[e:]
    return text


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, n, t in zip(pdf["file_id"], pdf["line"], pdf["text"]):
            if spans := scan(t):
                sure = [x for x in spans if x[2] != "bare"]
                rows.append((f, n, t, mask(t, sure) if sure else None, mask(t, spans), ",".join(sorted({r for _, _, r in spans}))))
        yield pd.DataFrame(rows, columns=["file_id", "line", "text", "masked_sure", "masked_all", "rules"]).astype({"file_id": "int64", "line": "int32"})


#: What a line needs to hold a secret at all, cheap enough for every line: a word of the rules, an address with a user, or a long run
#: of the characters of encoded data that isn't only letters, or an escape.
CANDIDATE = (r"(?i)passw|pass|pwd|pw\b|secret|token|key|auth|cred|bearer|kennwort|contrase|clave|identified|://[^/\s]*:[^/\s]*@|"
             r"private key|glpat-|[sr]k_live_|gh[pousr]_|xox[abeoprs]-|AKIA|ASIA|AIza|eyJ|\blog ?in\b|\buses\b|\bsig=|(?:^|\s)-u\s|\\x|%[0-9a-f]{2}|[\"']kty[\"']")
LONG = (r"(?<![A-Za-z0-9+/=_.\-])(?=[A-Za-z0-9+/=_.\-]{12})[A-Za-z0-9+/=_.\-]*?[0-9][A-Za-z+/]|"
        r"[\"'],? ?[\"'][^\"'\s]*[0-9][^\"'\s]*[\"']|\\u[0-9a-fA-F]{4}|\\[0-7]{3}")

WORDED = re.compile(CANDIDATE + r"|\blog ?in\b|remember|account|user|accès|zugang")
XML_NAME = re.compile(r"(?<=[\s<])(?:key|name|id)\s*=\s*\"[^\"]*\"")
IDENTIFIER = re.compile(r"[A-Za-z][a-z]*+(?:_?+[A-Z]?+[a-z]++|_?+[0-9]{1,4}+)*+|[A-Z]++(?:_[A-Z]++|_?+[0-9]{1,4}+)*+")

_BODY = r"^[\s\"'`+.,\\#*/;|&()]*(?:[A-Za-z0-9+/=]+|[A-Za-z-]+: .*|Proc-Type.*|DEK-Info.*)?(?:\\n|\\r)*[\s\"'`+.,\;|&()]*$"


def find_credentials(lines: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, line, text, masked, rules: each line of an indexed file that holds a credential, and its text with only the
    secret masked.

    A line with a null text holds none; repeated rows give one row; lines of unknown files are left out. A key over several
    lines counts from its opening to its closing marker if every line between is a body line; the body is masked, the
    markers stay.
    """
    rows = clean_lines(lines)
    wanted = rows.where(F.length("text") >= 6).where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(LONG))
    hits = wanted.mapInPandas(_scan_batches, "file_id bigint, line int, text string, masked_sure string, masked_all string, rules string").distinct()
    known = current_files(files)
    # a value without quotes is a name or a call in most languages, a literal elsewhere
    literal = F.col("language").isNull() | F.col("language").isin("shell", "dockerfile")
    single = (hits.join(known.select("file_id", "language"), "file_id")
              .select("file_id", "line", "text", F.when(literal, F.col("masked_all")).otherwise(F.col("masked_sure")).alias("masked"), "rules")
              .where(F.col("masked").isNotNull()))
    begin, end = F.col("text").rlike(PEM_BEGIN.pattern), F.col("text").rlike(PEM_END.pattern)
    markers = (rows.where(F.col("text").contains("PRIVATE KEY") & (begin != end)).select("file_id", "line", begin.alias("opens")).distinct())
    w = Window.partitionBy("file_id").orderBy("line")
    ranges = (markers.withColumn("last", F.when(~F.lead("opens").over(w), F.lead("line").over(w)))
              .where(F.col("opens") & F.col("last").isNotNull())
              .select("file_id", F.col("line").alias("first"), "last"))
    # ranges from an opening marker to the next one don't overlap, so these are no more lines than there are
    wanted = ranges.select("file_id", "first", "last", F.explode(F.sequence("first", "last")).alias("line"))
    inside = rows.join(small(wanted), ["file_id", "line"]).distinct().persist()
    body = F.col("text").rlike(_BODY)
    sound = inside.groupBy("file_id", "first").agg(F.min(body | F.col("line").isin(F.col("first"), F.col("last")) | begin | end).alias("ok"),
                                                   F.count_distinct("line").alias("n"), F.max(F.col("last") - F.col("first") + 1).alias("want"))
    block = (inside.join(sound.where(F.col("ok") & (F.col("n") == F.col("want")) & (F.col("n") > 2)).select("file_id", "first"), ["file_id", "first"])
             .join(known.select("file_id"), "file_id", "left_semi")
             .select("file_id", "line", "text", F.when(begin | end, F.col("text")).otherwise(F.regexp_replace("text", r"[A-Za-z0-9+/=]{4,}", MASK)).alias("masked"),
                     F.lit("pem").alias("rules")))
    return single.unionByName(block).groupBy("file_id", "line").agg(F.max_by(F.struct("text", "masked", "rules"), F.struct(F.col("rules") == "pem", "masked")).alias("r")).select("file_id", "line", "r.*")
