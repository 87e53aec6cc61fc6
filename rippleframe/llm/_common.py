"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in the query contracts: space and TAB..CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Settings of the executions that write a step: shuffle files go when it has ended, Arrow batches are small.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or one of our own where that is unset (as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="rippleframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(spark: SparkSession, write) -> None:
    """Run ``write`` (a call that writes a table) as an execution whose shuffle files go when it has ended."""
    before = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        write()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, replaces: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back (survives lost executors).

    The steps in ``replaces`` are deleted when the new one is complete: nothing may read them any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    write_once(spark, lambda: df.write.option("compression", "zstd").parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    forget(*replaces)
    return out


def forget(*steps: DataFrame) -> None:
    """Delete the folders of materialised steps that nothing reads any more."""
    for step in steps:
        path = getattr(step, "_step_path", None)
        if path:
            spark = step.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hash_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(name: str) -> Column:
    """A top-level column of any name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def outward(names: Iterable[str], results: Iterable[str]) -> list[str]:
    """The names input columns go out by: their own, with ``_input`` added where a result (or another one) has it."""
    taken, out = {r.lower() for r in results}, []
    for n in names:
        while n.lower() in taken:
            n += "_input"
        taken.add(n.lower())
        out.append(n)
    return out


def kept_columns(df: DataFrame, keep: Iterable[str], results: Iterable[str]) -> tuple[list[Column], list[str], str]:
    """The columns ``keep`` under their outward names, those names, and their schema text."""
    keep = list(keep)
    names = outward(keep, results)
    kinds = {f.name.lower(): f.dataType.simpleString() for f in df.schema}
    return [column(k).alias(n) for k, n in zip(keep, names, strict=True)], names, ", ".join(f"`{n.replace('`', '``')}` {kinds[k.lower()]}" for k, n in zip(keep, names, strict=True))


def sub_batches(values: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``values`` (string or binary) that hold about ``max_bytes`` each; one row may exceed it."""
    import numpy as np
    import pyarrow.compute as pc

    n = len(values)
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
        yield start, min(end, n)
        start = min(end, n)


def flat_bytes(values: pa.Array):
    """(uint8 array of all rows' bytes, int64 offsets of length n + 1) of a string array; null rows are empty."""
    import numpy as np

    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
