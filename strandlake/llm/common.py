"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space and the control characters 9-13.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Spark setting: remove the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is taken and set in local mode, as
    in tests; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strandlake-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back.

    Shuffle files of the job are not needed any more once it is written, so they
    are taken away at its end and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_strandlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = tempfile.mkdtemp(prefix="strandlake-package-")
    sc.addPyFile(shutil.make_archive(f"{target}/strandlake", "zip", root, "strandlake"))
    sc._strandlake_shipped = True


def map_pandas(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)
