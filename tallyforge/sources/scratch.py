"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it names none, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written and read again, so that lost executors do not make its steps run anew."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.kept_at = at
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of keep() that no later step reads."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
