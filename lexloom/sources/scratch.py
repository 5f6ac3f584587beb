"""Intermediate tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only where none is named, and then in local mode alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Python workers import this package, wherever they were started; sent once a session."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if not getattr(sc, "_lexloom_shipped", False):
        packed = Path(tempfile.mkdtemp(prefix="lexloom-")) / f"lexloom-{sc.applicationId}.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(packed))
        sc._lexloom_shipped = True


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: a table used several times is worked out once, and plans stay small.

    Its files say little of its size in memory, so joins do not broadcast it.
    """
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
