"""Generated, minified, third-party and data files among source files.

A random forest over compression ratio, token entropy, identifier lengths, comment density, line shapes, literals, size and path. Its labels
come from notices: files whose head or foot says that they were generated, imported or minified are examples of what is looked for, files without
any notice examples of the rest. The lines of a notice are taken out before the features are computed, so the forest can't see its labels. What a
notice or a path states outright isn't put to the vote.

Features are sums over blocks of lines, so that a long file is spread over many tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_LINES, current_files, text_blocks

TRAIN_ROWS = 12_000  # labelled rows the forest is fitted on, chosen by a hash of the id; every file is classified
TREES, DEPTH, SEED = 20, 8, 7
SURE = 0.1  # a first forest's probability below which an unlabelled file is an example of what people wrote
DATA_SHARE, DATA_LINES = 0.6, 8  # share of characters in literals, and lines, of a sure example of data
SERIES_SHARE, SERIES_LINES = 0.5, 8  # share of lines whose name goes on from the line before with the next number, of a file that a program counted out; fewer such lines don't count
HEAD, FOOT = 10, 4  # lines other than comments and empty ones that end the head and the foot, in whose comments a notice may stand
SAID = ("made", "taken", "small")

# How notices are worded in the languages they come in.
MADE = re.compile(r"(?i)auto-?\s?generated|automatically (?:generated|created|produced)|machine[- ]generated|code generated|(?<!originally )\bgenerated (?:by|from|with|using|on|at|code|file)\b|@generated|"
                  r"do not (?:edit|modify|change)|don'?t edit|edits? (?:are|will be) (?:over|lost)|changes (?:will be|are) (?:lost|over)|(?:auto)?build product|produced by \w+ (?:v|\d)|"
                  r"(?:produit|généré|cree|créé)\w* (?:automatiquement|par)|ne pas (?:modifier|éditer)|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|(?:erzeugt|generiert|erstellt)[ ,.;].*nicht (?:bearbeiten|ändern)|nicht (?:bearbeiten|ändern|editieren)|"
                  r"(?:generado|creado|producido)s? (?:por|autom)|no (?:editar|modificar)|wurde von \w+ (?:erzeugt|generiert|erstellt)")
TAKEN = re.compile(r"(?i)imported (?:unchanged|verbatim|as is)|(?:copied|taken|vendored|imported|mirrored) (?:unchanged |verbatim )?from (?!this)|\bupstream\b|independent (?:library|project|package)|third[- ]party|"
                   r"\bv?\d+\.\d+(?:\.\d+)?\b.*(?:released|licen[cs]ed|distributed|available) under|\bv?\d+\.\d+(?:\.\d+)?\b.*\(c\)\s*\d{4}|\(c\)\s*\d{4}[-\d, ]*\s.*(?:contributors|authors|foundation)\b.*(?:MIT|BSD|Apache|upstream|ISC|MPL)")
SMALL = re.compile(r"^\s*/\*!.*(?:\||\bv\d)")
KEPT = re.compile(r"(?i)(?:now |since )?(?:kept|maintained|edited|written) by hand|edit freely|this (?:module|file|script|class|program) (?:generates|writes|produces|creates)|talks to the|originally generated|"
                  r"handling|see also the|notes$|von hand|à la main|a mano")
HAND = re.compile(r"(?i)(?:kept|maintained|edited|written) by hand|edit freely|von hand|à la main|a mano")
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\"|'''|=begin)")
# Names of folders and files that say what is in them.
TAKEN_PATH = re.compile(r"(?i)(?:^|/)(?:third[_-]?party(?:[_-]?libs?)?|3rd[_-]?party|vendor(?:ed)?|node_modules|bower_components|jspm_packages|godeps|_vendor|extern|external|externals|subprojects|contrib/libs?|"
                        r"deps|site-packages|dist-packages|carthage|pods|public/assets/lib|assets/(?:lib|vendor)|static/(?:lib|vendor)|libs?/vendor)/(?:[^/]+/)*[^/]+$")
MADE_PATH = re.compile(r"(?i)(?:^|/)(?:generated|__generated__|generated[_-]?(?:sources?|src|code|files)|gen-src|autogen(?:erated)?|zz_generated[^/]*|codegen/output|build/generated|_generated|auto_generated|genfiles|gensrc)(?:/|\.)|"
                       r"(?:_pb2?(?:_grpc)?|\.pb|\.pb\.gw|_pb_service|\.g|\.generated|_generated|\.gen|_gen|\.designer|\.g\.i|_string|\.auto|_autogen|\.freezed|zz_generated[^/]*|_moc|\.moc|\.tab|\.yy)\.[A-Za-z]+$|(?:^|/)(?:moc_|ui_|qrc_)[^/]+\.\w+$")
SMALL_PATH = re.compile(r"(?i)[.-](?:min|prod|bundle|packed|compressed|chunk)\.(?:js|mjs|cjs|css|ts)$")

TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")
LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?<![\w$.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)")
DIGITS = re.compile(r"\d+")
NUMBERED = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*+(?:[.\[-][\w$]++)*(?<=[0-9])")
SUMS = ["n_chars", "n_blank", "z", "n_tokens", "h_tokens", "n_names", "l_names", "n_short", "n_digits", "n_comment", "c_comment", "c_literal", "n_long", "n_shapes", "n_shown", "c_space", "n_defs", "n_series"]


def _ends(numbered: list[tuple[int, str]], most: int) -> Iterator[int]:
    """From one end on, the lines of comments before ``most`` other lines; comments of any length don't count, so a licence hides no notice below it."""
    for i, t in numbered:
        if COMMENT.match(t):
            yield i
        elif t.strip():
            most -= 1
            if not most:
                return


def notices(lines: list[str], first: bool = True) -> tuple[set[int], tuple[bool, bool, bool], tuple[bool, bool, bool]]:
    """The lines that hold a notice, and whether one in the head, or in the foot, says generated, taken over, minified. Only a file's first block has a head."""
    numbered = list(enumerate(lines))
    at: set[int] = set()
    said = []
    for places in (set(_ends(numbered, HEAD)) if first else set(), set(_ends(numbered[::-1], FOOT))):
        made = taken = small = False
        for i in places:
            t = lines[i]
            if t.lstrip().startswith("/*"):
                t = t[:t.find("*/", t.find("/*") + 2) + 2 or None] if "*/" in t else t
            if KEPT.search(t):
                at.add(i)
                continue
            m, k, s = MADE.search(t), TAKEN.search(t), SMALL.match(t)
            if m or k or s:
                at.add(i)
                made, taken, small = made or bool(m), taken or bool(k), small or bool(s)
            elif re.search(r"(?i)copyright|\blicen[cs]e|spdx", t):
                at.add(i)
        said.append((made, taken, small))
    return at, said[0], said[1]


def _next(a: str, b: str) -> bool:
    """Whether the name b begins as a does and ends with the number after that at the end of a; what stands between may differ and end with digits itself."""
    stem = a.rstrip("0123456789")
    digits = a[len(stem):][-9:]
    return b.startswith(stem[:3]) and any(b.endswith(str(int(digits[i:]) + 1).zfill(len(digits) - i)) for i in range(len(digits)))


def series(lines: list[str]) -> int:
    """How many lines have, in the place of a numbered name of the line before, a name with the next number; empty lines don't part them."""
    n, before = 0, []
    for t in lines:
        names = NUMBERED.findall(t)
        n += any(map(_next, before, names))
        if names or t.strip():
            before = names
    return n


def measure(lines: list[str]) -> list[float]:
    """The sums of SUMS, and the longest line."""
    text = "\n".join(lines)
    tokens = TOKEN.findall(text)
    counts, n = Counter(tokens), len(tokens)
    h = -sum(c * math.log2(c / n) for c in counts.values()) if n else 0.0
    names = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] in "_$"]
    comment = [t for t in lines if COMMENT.match(t)]
    literal = sum(map(len, LITERAL.findall(text)))
    shown = [t for t in lines if t.strip()]
    return [len(text), len(lines) - len(shown), len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)), n, h, sum(c for _, c in names), sum(len(t) * c for t, c in names),
            sum(c for t, c in names if len(t) <= 3), sum(len(t) * c for t, c in counts.items() if t[0].isdigit()), len(comment), sum(map(len, comment)), literal, sum(len(t) > 300 for t in lines),
            len(set(DIGITS.sub("0", text).split("\n"))), len(shown), sum(len(t) - len(t.lstrip()) for t in lines),
            sum(c for t, c in names if t in ("def", "function", "func", "class", "return", "if", "for", "while")), series(lines)] + [max(map(len, lines), default=0)]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, b, head, text in zip(pdf["file_id"], pdf["block"], pdf["head"], pdf["text"]):
            lines = text.split("\n") if text else []
            at, top, foot = notices(lines, b == 0)
            left = [t for i, t in enumerate(lines) if i not in at] if at else lines
            hand = b == 0 and bool(at) and any(i in at and HAND.search(t) for i, t in enumerate(lines[:max(at) + 1]) if COMMENT.match(t))
            rows.append((f, b, head, *measure(left), len(left), *top, *foot, hand))
        yield pd.DataFrame(rows, columns=["file_id", "block", "head", *SUMS, "longest", "n_lines", *SAID, *(f"foot_{c}" for c in SAID), "hand"]).astype({"file_id": "int64"} | {c: "float64" for c in [*SUMS, "longest", "n_lines"]})


def features(lines: DataFrame, files: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per indexed file with a language and at least one line that isn't empty: file_id, path, language, the features, made, taken, small (what its notices say), hand (whether its first block says that it is kept by hand)."""
    known = current_files(files).where(F.col("language").isNotNull())
    heads = known.select("file_id", F.to_json(F.struct("path", "language", "size")).alias("head"))
    blocks = text_blocks(lines, heads, block_lines).select("file_id", "block", "head", "text")
    types = ", ".join(f"{c} double" for c in [*SUMS, "longest", "n_lines"])
    parts = blocks.mapInPandas(_measure, f"file_id bigint, block int, head string, {types}, " + ", ".join(f"{c} boolean" for c in [*SAID, *(f"foot_{c}" for c in SAID), "hand"]))
    whole = parts.groupBy("file_id").agg(F.max("head").alias("head"), *(F.sum(c).alias(c) for c in [*SUMS, "n_lines"]), F.max("longest").alias("longest"), F.max("hand").alias("hand"), *((F.max(c) | F.max_by(f"foot_{c}", "block")).alias(c) for c in SAID))
    meta = F.from_json("head", "path string, language string, size bigint")
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1.0))).alias(f"{a}_per_{b}")
    rows = whole.where(F.col("head").isNotNull() & (F.col("n_shown") > 0)).withColumn("m", meta).select(
        "file_id", F.col("m.path").alias("path"), F.col("m.language").alias("language"), "made", "taken", "small", "hand",
        per("z", "n_chars"), per("h_tokens", "n_tokens"), per("l_names", "n_names"), per("n_short", "n_names"), per("n_digits", "n_chars"), per("n_comment", "n_lines"), per("c_comment", "n_chars"),
        per("c_literal", "n_chars"), per("n_long", "n_lines"), per("n_shapes", "n_lines"), per("n_chars", "n_lines"), per("c_space", "n_chars"), per("n_names", "n_tokens"), per("n_tokens", "n_chars"), per("n_defs", "n_lines"), F.when(F.col("n_series") >= SERIES_LINES, F.col("n_series") / F.col("n_shown")).otherwise(0.0).alias("n_series_per_n_shown"),
        per("n_blank", "n_lines"), F.log1p("longest").alias("longest"), F.log1p("n_lines").alias("n_lines"), F.log1p(F.coalesce(F.col("m.size"), F.lit(0)).cast("double")).alias("size"),
        *(F.col("m.path").rlike(p.pattern).cast("double").alias(c) for c, p in (("p_taken", TAKEN_PATH), ("p_made", MADE_PATH), ("p_small", SMALL_PATH))),
        F.col("m.path").rlike(r"/[A-Za-z][\w]*-v?\d+\.\d+[^/]*/").cast("double").alias("p_version"),
        *(F.col("m.language").eqNullSafe(x).cast("double").alias(f"is_{x}") for x in ("javascript", "css", "html", "dockerfile", "c", "java")))
    return rows


NOT_FEATURES = {"file_id", "path", "language", "made", "taken", "small", "hand"}


def _forest() -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=3, maxBins=32, subsamplingRate=0.8)


def classified(lines: DataFrame, files: DataFrame, train_rows: int = TRAIN_ROWS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, path, language, kind, probability: each indexed file with a language and a text; kind is null for what people wrote.

    Null texts are empty lines, repeated rows count once, empty files and files without a language are left out. Without examples of both sorts
    only notices and numbered lines decide.
    """
    rows = features(lines, files, block_lines).persist()
    noticed, named = F.col("made") | F.col("small") | F.col("taken"), F.col("p_made") + F.col("p_small") + F.col("p_taken") > 0
    data = (F.col("c_literal_per_n_chars") >= DATA_SHARE) & (F.col("n_lines") >= math.log1p(DATA_LINES))
    own = F.col("hand") & ~noticed & ~named  # says that people keep it, and nothing says otherwise
    counted = (F.col("n_series_per_n_shown") >= SERIES_SHARE) & ~own
    # a path that says what a file is counts as a feature; such a file without a notice is an example of neither sort
    labelled = rows.where(noticed | data | counted | ~named).withColumn("label", (noticed | data | counted).cast("double")).orderBy(F.xxhash64("file_id"), "file_id").limit(train_rows)
    names = [c for c in rows.columns if c not in NOT_FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="keep")
    train = vectors.transform(labelled).select("v", "label").persist()
    if train.select("label").distinct().count() < 2:
        scored = rows.withColumn("probability", F.lit(0.0))
    else:
        # Files without a notice are unlabelled rather than negative, and some with one look like any other. So a first forest tells which
        # unlabelled files are surely negative and which labelled ones are typical; the second is fitted on these.
        first = _forest().fit(train)
        sure = first.transform(train).withColumn("p", vector_to_array("probability")[1]).where((F.col("label") > 0) == (F.col("p") >= SURE)).select("v", "label").persist()
        model = _forest().fit(sure) if sure.select("label").distinct().count() == 2 else first
        scored = model.transform(vectors.transform(rows)).withColumn("probability", vector_to_array("probability")[1]).drop("v", "rawPrediction", "prediction")
        sure.unpersist()
    train.unpersist()
    found = (F.col("probability") >= 0.5) & ~own
    kind = (F.when((F.col("made") | counted & ~F.col("small") & ~F.col("taken") | found & (F.col("p_made") > 0)), "generated").when(F.col("small") | found & (F.col("p_small") > 0), "minified").when(F.col("taken") | found & (F.col("p_taken") > 0), "third party")
            .when(found, F.when(F.col("longest") > math.log1p(600), "minified").when(F.col("c_literal_per_n_chars") > 0.6, "data").otherwise("generated")))
    return scored.select("file_id", "path", "language", kind.alias("kind"), F.when(found, "forest").when(noticed, "notice").when(counted, "series").alias("by"), F.round("probability", 6).alias("probability"), *[c for c in names if c not in ("file_id",)])


def not_written(lines: DataFrame, files: DataFrame, train_rows: int = TRAIN_ROWS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, kind: the files that people did not write here."""
    return classified(lines, files, train_rows, block_lines).where(F.col("kind").isNotNull()).select("file_id", "kind", "by", "probability")
