"""Small helpers that the text operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bits for each id of a bitmap, and of a whole one at most (32 MB); bits of one row of it, which Spark's function sets.
ID_BITS, MOST_BITS, ROW_BITS = 16, 1 << 28, 1 << 15


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def one_row_per_id(df: DataFrame, key: str, *kept: str) -> DataFrame:
    """``key`` and the columns ``kept``, one row for each non-null key.

    Where rows repeat a key, the row with the least values of ``kept`` (nulls
    first) stands for it. Only when the keys are found to repeat are the other
    columns shuffled.
    """
    rows = df.select(key, *kept).where(F.col(key).isNotNull())
    repeats = rows.groupBy(key).count().where("count > 1").limit(1).count()
    if not repeats:
        return rows
    if not kept:
        return rows.distinct()
    least = rows.groupBy(key).agg(F.min(F.struct(*kept)).alias("_least"))
    # written, so that a task that is run again sees its rows in the same order
    return materialize(least.select(key, *[F.col("_least")[c].alias(c) for c in kept]), "one")


def keyed_rows(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc_id, text, _row``: a whole number of its own for each row, its text, and all its columns.

    The number is the row's key where keys are whole, not null and never repeat. Otherwise it is the row's place in the
    order of key (nulls last) and text, so that of equal keys or texts the same row comes first; equal rows are in no
    fixed order.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(column).alias("text"), F.struct(*df.columns).alias("_row"))
    whole = dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    again = rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if whole and again.isEmpty():
        return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    placed = with_global_index(rows, [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")], "_at")
    return placed.select(F.col("_at").cast("long").alias("doc_id"), "text", "_row")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound what a Python task holds at a time: the session's Arrow batches have ``rows`` rows and ``size`` bytes at most, or a longer row."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
        now = int(number) << 10 * " kmgt".index(unit or " ")
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def shuffle_count(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parted(df: DataFrame, some: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among those of ``some``, and those whose key surely is not.

    A bitmap of hashes of the keys is broadcast, so that only the first kind needs a join, and with it a shuffle of its
    texts; an exact join has to follow there. Of other keys one in ``ID_BITS`` comes with them, and more where the bitmap would pass
    ``MOST_BITS``. Null keys are of the second kind. ``some`` should be written, as it is read twice.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (ID_BITS * some.count()).bit_length()))
    slot = lambda column: F.pmod(F.xxhash64(column), F.lit(bits))
    slots = some.where(F.col(key).isNotNull()).select(slot(key).alias("_slot")).select(F.expr(f"_slot div {ROW_BITS}").alias("_map"), (F.col("_slot") % ROW_BITS).alias("_bit"))
    maps = materialize(slots.repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmap")
    own = df.withColumn("_slot", slot(key)).withColumn("_map", F.expr(f"_slot div {ROW_BITS}")).join(F.broadcast(maps), "_map", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_slot") % ROW_BITS / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.col(key).isNotNull() & F.coalesce((F.call_function("shiftright", byte, (F.col("_slot") % 8).cast("int")) % 2) == 1, F.lit(False))
    return own.where(hit).select(*df.columns), own.where(~hit).select(*df.columns)
