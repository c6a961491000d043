"""Tables written to the folder that all nodes of the cluster share.

Intermediate results that are read more than once are written here as Parquet. That cuts the lineage, so that an
executor lost later costs no recomputation, and keeps plans short.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_open: ContextVar[list[str] | None] = ContextVar("tables written in the innermost scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder of this machine if Spark runs on it alone, else an error."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all nodes of the cluster share")
        folder = f"file://{tempfile.mkdtemp(prefix='editstrata-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again. The table is deleted when the driver ends, if no scope deletes it before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/editstrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    if (tables := _open.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As written(), but the table outlives the scope that it is written in."""
    tables = _open.get()
    out = written(df, name)
    if tables is not None:
        tables.pop()
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that written() wrote inside it; what goes out must not read them."""
    tables: list[str] = []
    before = _open.set(tables)
    try:
        yield
    finally:
        _open.reset(before)
        for path in tables:
            _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
