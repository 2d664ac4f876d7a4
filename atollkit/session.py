"""Session and table helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "atollkit") -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("ATOLLKIT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests), which is a
    single process, gets a new one; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def written(df: DataFrame, most: int = 0) -> DataFrame:
    """df written to the shared folder and read again, so that plans that use it several times do not work it out each time. most: rows of a
    file, 0 for any number. Columns without a type, which files cannot have, are made again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    kept = df.drop(*(c for c, kind in df.dtypes if kind == "void"))
    kept.write.option("maxRecordsPerFile", most).parquet(path)
    out = df.sparkSession.read.schema(kept.schema).parquet(path)
    return out.select(*(c if c in kept.columns else F.lit(None).alias(c) for c in df.columns)) if len(kept.columns) < len(df.columns) else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
