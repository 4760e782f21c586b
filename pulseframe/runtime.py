"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: send it once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_pulseframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="pulseframe-py-"), "pulseframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(path)
    sc._pulseframe_shipped = True


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder, that of ``spark.checkpoint.dir``; only where that is unset, on a local master, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="pulseframe-checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in ``spark.checkpoint.dir``, so that what follows neither repeats nor loses it."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
