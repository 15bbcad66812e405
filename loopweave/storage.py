"""Tables in the folder that the driver and the executors share, to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder of this machine if Spark runs within it, as in tests;
    on a cluster other machines would not see one, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
            raise RuntimeError(f"spark.checkpoint.dir is unset; on {master} it has to name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="loopweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended: whoever owns the shared folder clears it
        pass


def _own(spark: SparkSession, path: str) -> None:
    """The innermost open ``scratch`` deletes the path, or the end of the session."""
    if stack := getattr(_scopes, "stack", None):
        stack[-1].append((spark, path))
    else:
        atexit.register(_delete_quietly, spark, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``written`` makes inside go when the block ends, but for those that ``keep`` names. A DataFrame that still
    reads one of them must have been written before."""
    stack = _scopes.stack = getattr(_scopes, "stack", None) or []
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            _delete_quietly(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """``df``, a table of ``written``, outlives the innermost ``scratch``: it goes with what is around that."""
    stack = _scopes.stack
    mine = next(entry for entry in stack[-1] if entry[1] == df.written_path)
    stack[-1].remove(mine)
    inner = stack.pop()
    _own(*mine)
    stack.append(inner)
    return df


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. What is there goes with the innermost ``scratch``, or when the session ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _own(spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to a ``fresh_path`` and reads it back, so that a lost executor costs nothing before it."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that no later step reads."""
    if path := getattr(df, "written_path", None):
        delete(df.sparkSession, path)
