"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new name in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is taken in local mode, as in tests;
    on a cluster, whose machines would not share it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandlake-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_strandlake_shipped", False):
        return
    target = tempfile.mkdtemp(prefix="strandlake-package-")
    sc.addPyFile(shutil.make_archive(f"{target}/strandlake", "zip", Path(__file__).resolve().parents[1], "strandlake"))
    sc._strandlake_shipped = True
