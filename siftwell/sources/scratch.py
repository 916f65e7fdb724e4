"""Tables that a plan reads more than once, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder path that driver and executors share, below ``spark.checkpoint.dir``.

    Where that setting is absent, a local master gets a temporary folder; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local()
    folder = "/".join((qualified(spark, base).rstrip("/"), "siftwell", *_passing.get()))
    return f"{folder}/{what}-{uuid.uuid4().hex}"


#: Folders of the blocks that this thread is in; a thread that it starts is in none, unless it runs in a copied context.
_passing: ContextVar[tuple[str, ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made in this block go when it ends: what it makes must have been written elsewhere by then.

    Only those made by the thread that is in the block: queries of other threads keep their tables.
    """
    token = _passing.set((*_passing.get(), f"passing-{uuid.uuid4().hex}"))
    try:
        probe = scratch(spark, "any")
        yield
    finally:
        _passing.reset(token)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(probe).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@cache
def _local() -> str:
    """A temporary folder of this process, which goes with it."""
    folder = tempfile.mkdtemp(prefix="siftwell-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark gives it, so that readers other than Spark find the same place."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def stored(df: DataFrame, what: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Writes df to a shared table and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    path = path or scratch(df.sparkSession, what)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
