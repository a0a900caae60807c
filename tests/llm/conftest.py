import pytest
from pyspark.sql import functions as F

FILES = "id bigint, path string, language string, extension string, size bigint, mtime bigint, content_hash string, index_status string"
LINES = "file_id bigint, line int, text string"


@pytest.fixture
def tables(spark):
    """(lines, files) of a dict id -> (path, language, text): with repeated rows, an older state of each file, rows of skipped and unknown files, nulls, and further
    columns whose names the operators use themselves."""

    def make(texts, dirt=True):
        files = [(i, p, g, "." + p.rsplit(".", 1)[-1], len(t or ""), 100, "h", "indexed") for i, (p, g, t) in texts.items()]
        lines = [(i, n, s) for i, (_, _, t) in texts.items() if t is not None for n, s in enumerate(t.split("\n"), 1)]
        if dirt:
            files += [(i, p, "cobol", e, 1, 50, "old", "indexed") for i, p, _, e, *_ in files] + files[:2] + [(990, "r/skip.py", "python", ".py", 1, 1, "h", "skipped"), (None, None, None, None, None, None, None, None)]
            lines += lines[:3] + [(990, 1, "def broken("), (991, 1, 'password = "Hunter2!x"'), (None, 1, "x"), (7000, None, "x")]
        fdf, ldf = spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)
        if dirt:
            for c in ("text", "block", "head", "file_id", "line", "n"):
                fdf = fdf.withColumn(c, F.lit("clash"))
            for c in ("language", "path", "block", "head", "id", "h", "k", "a", "rules"):
                ldf = ldf.withColumn(c, F.lit("clash"))
        return ldf, fdf

    return make
