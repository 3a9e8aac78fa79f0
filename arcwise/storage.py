"""Cutting lineage: tables written to the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all of Spark is one
process (local tests) is a temporary folder chosen; a cluster has to name one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables and checkpoints, as a URI or path."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arcwise-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, label: str = "table") -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later reads survive lost executors and start from a flat plan.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing may read them or what is not yet written of theirs again."""
    for table in tables:
        if path := getattr(table, "written_to", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def rows_of(df: DataFrame) -> int | None:
    """The number of rows, which Parquet's footers tell, if ``materialize`` wrote ``df``; else None."""
    return df.count() if getattr(df, "written_to", None) else None


def parts_for(spark: SparkSession, rows: int, of: int = 1_000_000) -> int:
    """How many partitions hold ``rows`` rows with some ``of`` in each; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // of))


def dealt(df: DataFrame, rows: int | None, *keys: str, of: int = 250_000) -> DataFrame:
    """``df`` dealt by its keys into parts of some ``of`` of its ``rows`` rows, if those are more than the session's; else (or if None) as it is."""
    n = 0 if rows is None else parts_for(df.sparkSession, rows, of)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextmanager
def copartitioned(spark: SparkSession) -> Iterator[None]:
    """While this lasts, tables dealt by some of a join's keys are joined where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
