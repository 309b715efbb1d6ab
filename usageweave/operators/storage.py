"""Materialising intermediate results where every executor can reach them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """A folder for a local session that names none; it goes when the session ends."""
    folder = tempfile.mkdtemp(prefix="usageweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def require_scratch(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster the shared folder has to be configured.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = _own_folder()
    return base.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder under the scratch folder."""
    return f"{require_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    This cuts the lineage, pins non-deterministic columns such as the slice
    number, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
