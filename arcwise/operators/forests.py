"""Rooted forests numbered by Euler tours, and extremes over their subtrees.

No step counts levels: tours are ranked by pointers that double, and a subtree,
which is a range of preorder numbers, is looked up in tables of ranges that
double. So a path takes as few rounds as a bush.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.functions.ranking import list_ranks, with_global_index
from arcwise.storage import forget, materialize


def preorder(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, parent, pre, size`` of a forest of edges ``src, dst``: preorder numbers over all trees from 0, and subtree sizes.

    ``roots`` has one ``id`` for each tree. Every edge is a dart each way; after a dart comes the next one out of
    where it arrives, in the order of the far ends, so the darts of a tree make one ring, which is cut at its root.
    Darts are numbered by vertex first: the next one has the next number, and only a vertex's last goes back to its
    first, so that a hub's darts never meet in one group. Trees follow each other in no stated order. No edges: no rows.
    """
    both = tree.select("src", "dst").union(tree.select("dst", "src"))
    darts = materialize(with_global_index(both, ["src", "dst"], "k"), "darts")
    ends = darts.groupBy("src").agg(F.min("k").alias("first"), F.max("k").alias("last_k"))
    ends = ends.join(roots.select(F.col("id").alias("src"), F.lit(True).alias("is_root")), "src", "left")
    back = darts.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("k").alias("twin"))
    paired = materialize(darts.join(back, ["src", "dst"]), "twins")
    turn = ends.select(F.col("last_k").alias("twin"), "first", F.coalesce("is_root", F.lit(False)).alias("is_root"))
    after = F.when(F.col("first").isNull(), F.col("twin") + 1).when(~F.col("is_root"), F.col("first"))
    ranks = list_ranks(paired.join(turn, "twin", "left").select(F.col("k").alias("id"), after.alias("next")))
    # a dart goes down if it comes before its twin, that is, has more steps to go
    here = paired.join(ranks.withColumnRenamed("id", "k"), "k")
    there = ranks.select(F.col("id").alias("twin"), F.col("steps").alias("back_steps"))
    down = here.join(there, "twin").where("steps > back_steps").select(F.col("dst").alias("id"), F.col("src").alias("parent"), "last", "steps", ((F.col("steps") - F.col("back_steps") + 1) / 2).cast("long").alias("size"))
    down = materialize(down, "down")
    sizes = down.groupBy("last").agg((F.max("steps") + 1).alias("steps"), (F.count(F.lit(1)) + 1).alias("size"))
    tops = sizes.join(paired.select(F.col("k").alias("last"), F.col("dst").alias("id")), "last")
    tops = tops.select("id", F.lit(None).cast(down.schema["parent"].dataType).alias("parent"), "last", "steps", "size")
    rows = with_global_index(down.union(tops), [F.col("last"), F.desc("steps")], "pre")
    numbered = materialize(rows.select("id", "parent", "pre", "size"), "preorder")
    forget(darts, paired, ranks, down)
    return numbered


def range_extremes(rows: DataFrame, block: int = 256) -> DataFrame:
    """``pre, low, high``: the least ``lo`` and greatest ``hi`` over the rows numbered from ``pre`` to ``pre + size - 1``.

    ``rows`` has ``pre, size, lo, hi``, all long; numbers go from 0 without gaps, and ranges end within them. Rows are packed
    into blocks of ``block`` numbers. A range inside its block is read from the block. What a longer one has past its
    first block depends on that block and the range's end alone, so each such pair is looked up once: the end's block
    up to the end, and the blocks between in a table of runs of 1, 2, 4, ... blocks.
    """
    at = (F.col("pre") % block).cast("int")
    packed = rows.groupBy(F.expr(f"pre div {block}").alias("b")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "pre", "size", "lo", "hi"))).alias("rows"))
    laid = packed.select("b", F.col("rows.lo").alias("los"), F.col("rows.hi").alias("his"), F.inline("rows"))
    inside = F.least(F.col("size"), F.lit(block) - F.col("at")).cast("int")
    laid = laid.select(
        "b", "pre", (F.col("pre") + F.col("size") - 1).alias("e"), (F.col("at") + F.col("size") > block).alias("on"),
        F.array_min(F.slice("los", F.col("at") + 1, inside)).alias("low"), F.array_max(F.slice("his", F.col("at") + 1, inside)).alias("high"),
        F.array_min(F.slice("los", F.lit(1), F.col("at") + 1)).alias("up_low"), F.array_max(F.slice("his", F.lit(1), F.col("at") + 1)).alias("up_high"),
    )
    laid = materialize(laid, "blocks")
    asked = laid.where("on").groupBy("b", "e").count().select("b", "e", (F.expr(f"e div {block}") - F.col("b") - 1).alias("between"))
    asked = materialize(asked.withColumn("k", F.when(F.col("between") > 0, F.length(F.bin("between")) - 1)), "ranges")
    most = asked.agg(F.max("k")).first()[0]
    runs = [materialize(packed.select(F.lit(0).alias("k"), "b", F.array_min("rows.lo").alias("l"), F.array_max("rows.hi").alias("h")), "runs")]
    for k in range(most or 0):
        nxt = runs[-1].select((F.col("b") - (1 << k)).alias("b"), F.col("l").alias("l2"), F.col("h").alias("h2"))
        runs.append(materialize(runs[-1].join(nxt, "b").select(F.lit(k + 1).alias("k"), "b", F.least("l", "l2").alias("l"), F.greatest("h", "h2").alias("h")), "runs"))
    table = reduce(DataFrame.union, runs)
    ends = laid.select(F.col("pre").alias("e"), "up_low", "up_high")
    front = table.select("k", (F.col("b") - 1).alias("b"), F.col("l").alias("l1"), F.col("h").alias("h1"))
    rear = table.select("k", F.col("b").alias("rb"), F.col("l").alias("l2"), F.col("h").alias("h2"))
    found = asked.join(ends, "e").join(front, ["k", "b"], "left")
    found = found.withColumn("rb", F.expr("b + 1 + between - shiftleft(1L, k)"))
    found = found.join(rear, ["k", "rb"], "left").select("b", "e", F.least("up_low", "l1", "l2").alias("far_low"), F.greatest("up_high", "h1", "h2").alias("far_high"))
    done = laid.join(found, ["b", "e"], "left").select("pre", F.when(F.col("on"), F.least("low", "far_low")).otherwise(F.col("low")).alias("low"), F.when(F.col("on"), F.greatest("high", "far_high")).otherwise(F.col("high")).alias("high"))
    result = materialize(done, "extremes")
    forget(laid, asked, *runs)
    return result
