"""Intermediate tables in the folder that all executors share, from which lost work restarts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_UNSET: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; without one a local session gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _UNSET:
        _UNSET[app] = "file://" + tempfile.mkdtemp(prefix="spark-orthomill-")
    return _UNSET[app]


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps restart from files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orthomill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads; others stay."""
    for df in tables:
        if "written_to" not in df.__dict__:
            continue
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_to"])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
