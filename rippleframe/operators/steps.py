"""Steps of iterative operators: written tables that cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or one of our own where that is unset (as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="rippleframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def step(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once: written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def met(df: DataFrame) -> DataFrame:
    """The same rows, to be met by a merge join: what is broadcast goes through the driver first."""
    return df.hint("merge")


def forget(*steps: DataFrame) -> None:
    """Delete the folders of steps that nothing reads any more."""
    for old in steps:
        path = getattr(old, "_step_path", None)
        if path:
            place = old.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(old.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
