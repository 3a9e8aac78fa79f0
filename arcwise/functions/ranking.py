"""Positions in a global order without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwise.storage import forget, materialize


def free_names(df: DataFrame, *names: str, but: str = "") -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in [*df.columns, but]}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def with_global_index(df: DataFrame, order: list, index: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add ``index``, the 0-based position of each row in the order ``order``.

    Rows are dealt into ranges of the order, numbered inside their range, and
    shifted by the sizes of the ranges before. Only one row per range (a number
    that the session sets) meets in a single task. Equal rows get neighbouring
    positions in no fixed order.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, start = free_names(df, "at", "part", "start", but=index)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = materialize(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumn(part, F.shiftright(at, 33).cast("int"))
    sizes = laid.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    # at most one row per range: the bound is the session's partition number
    placed = laid.join(F.broadcast(starts), part)
    place = F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)
    return placed.withColumn(index, place).drop(part, at, start)


def with_running_sum(df: DataFrame, order: list, value, total: str = "total") -> DataFrame:
    """Add ``total``, the sum of ``value`` over all rows up to and with each row in the order ``order``.

    Sums run inside ranges of the order, which are bounded by the rows over the session's partitions, and are
    shifted by the sums of the ranges before. Rows that are equal in ``order`` need a value of 0, or their sums are
    in no fixed order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, part, run, start = free_names(df, "value", "part", "run", "start", but=total)
    dealt = df.withColumn(own, value.cast("long")).repartitionByRange(parts, *order)
    laid = materialize(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    sums = laid.groupBy(part).agg(F.sum(own).alias("sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumn(run, F.sum(own).over(within))
    # at most one row per range: the bound is the session's partition number
    return summed.join(F.broadcast(starts), part).withColumn(total, F.col(start) + F.col(run)).drop(own, part, run, start)


def list_ranks(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, last, steps`` for lists ``id, next``: the list's last row, and how many links lead there (0 for itself).

    ``next`` is null at a list's end, and no two rows have the same one. Pointers double in each round, so a list takes
    as many rounds as its length has bits. Only rows that are not at their end yet look further, each at a row of its
    own, so no key is asked for twice. A ring has no end and is an error.
    """
    state = links.select("id", F.coalesce("next", "id").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("next").isNull().alias("done"))
    state = materialize(state, "ranks")
    for _ in range(max_rounds):
        if not state.where("NOT done").limit(1).count():
            return state.select("id", "last", "steps")
        ahead = state.select(F.col("id").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(ahead, "last").select("id", F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        old, state = state, materialize(state.where("done").union(moved), "ranks")
        forget(old)
    raise ValueError("a list has no end")
