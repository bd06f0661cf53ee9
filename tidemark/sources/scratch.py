"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: The folders that staged() made inside freed().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def path_of(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path, of any kind of storage that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    system, at = path_of(spark, path)
    system.delete(at, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Deletes what staged() writes inside, at the end: for a step that leaves nothing lazy behind, such as a micro-batch."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all of Spark runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A table without rows, known as such when a plan is made, so that joins and unions with it fall away."""
    fields = StructType.fromDDL(ddl).fields
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def staged(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """df written as a table below the shared folder and read back, so that later passes don't compute it again.

    Hex digests and keys are most of what is written, and zstd takes them to half of what the default gives.
    """
    if fmt == "parquet":
        options = {"compression": "zstd"} | options
    path = f"{shared_folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.format(fmt).options(**options).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)
