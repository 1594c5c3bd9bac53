"""What driver and executors share: a folder for durable cuts of lineage, and the path of this library."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_path(f):
    """f, whose first argument is a session, with the folder of this library on the path of Python workers, wherever the session was started from."""

    @wraps(f)
    def run(spark: SparkSession, *rest, **named) -> DataFrame:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _HOME not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_HOME, *paths])
        return f(spark, *rest, **named)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder from spark.checkpoint.dir; where it is unset and the session is local, one temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="gridloom-"))
    return _own_dir[0]


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, and lost executors cost nothing."""
    return _write(df)[0]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A cut() whose tables are deleted at the end: what outlasts it is cut by the plain one before."""
    made: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        got, path = _write(df)
        made.append(path)
        return got

    try:
        yield write
    finally:
        for path in made:
            delete(spark, path)
