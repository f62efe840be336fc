"""Written intermediate tables.

A table written to the shared folder named by ``spark.checkpoint.dir`` cuts lineage and survives lost
executors. Reread, it carries no partitioning, so a join on it exchanges both sides, which lets adaptive
execution split skewed keys; and its file size is known when the next plan is made, so Spark's own broadcast
threshold decides between a broadcast and a sort-merge join.

Tables go when the application ends, or at the end of a :func:`scope`: an operator that makes several tables on the
way to one opens a scope, writes the one with ``keep=True``, and leaves. What is deleted then is needed by no plan that goes on.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths made in the scopes around this thread's work, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one machine (``local``) gets a folder of its own; on a
    cluster that would be a different folder for each executor, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def fresh_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing has yet. It goes with the innermost scope (with ``keep``: with the one around it), or
    when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    _files(spark, path, lambda files, at: files.deleteOnExit(at))
    return path


def written(df: DataFrame, label: str = "table", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again. Nothing is cached."""
    spark = df.sparkSession
    path = fresh_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes in the block go at its end, but for those to keep."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            _files(spark, path, lambda files, at: files.delete(at, True))


def _files(spark: SparkSession, path: str, do) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
