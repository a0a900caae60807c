"""Sessions: shipping the package to the executors, and where checkpoints go."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python workers once per application, unless they have it on their path already.

    The driver serves the archive itself, so no shared folder is needed for it.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        with io.BytesIO() as raw:
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            path = os.path.join(tempfile.mkdtemp(), "loamdex_package.zip")
            Path(path).write_bytes(raw.getvalue())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the folder of ``spark.checkpoint.dir`` and reads it from there, so that an executor's loss costs no lineage. The folder is the
    session's; where none is set a folder of this machine is taken in local mode, as in tests, and a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loamdex-checkpoints-"))
    return df.checkpoint()
