"""Tables that cut lineage: Parquet in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local master, whose driver and executors are one process, may do without it: a folder of its own
    then serves.  Elsewhere a machine's own folder would lose rows, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lexwright-"))
        at = _OWN[0]
    return at.rstrip("/")


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as a table is written; it is then as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, size: str = "8m"):
    """While a table is written its Python workers get their rows in batches of so many bytes."""
    return setting(spark, _BYTES, size)


def written(df: DataFrame, tag: str, spent: bool = False) -> DataFrame:
    """The rows of df as a Parquet table in the scratch folder.

    Unlike a cache it outlives executors, and unlike a localCheckpoint every executor can read it.
    With spent the files that were shuffled for it go as soon as it is written, and not at some later collection
    of the driver's garbage; df must not stand on a cache.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark), setting(spark, _SPENT, "true") if spent else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
