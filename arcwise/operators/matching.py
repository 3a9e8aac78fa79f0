"""Matchings found by locally best edges, and the bipartite ones.

The loops choose many edges a round. What they guarantee is stated with each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators.graph import Graph
from arcwise.storage import dealt, materialize


def _locally_best(edges: DataFrame) -> DataFrame:
    """Edges ``src, dst, key``: those that both ends like best (least key), then again among the rest."""
    open_edges, chosen = materialize(edges), []
    while n := open_edges.count():
        e = F.struct("key", "src", "dst")
        ends = dealt(open_edges.select(e.alias("e"), F.explode(F.array("src", "dst")).alias("id")), 2 * n, "id")
        best = dealt(ends.groupBy("id").agg(F.min("e").alias("e")), 2 * n, "e")
        mutual = materialize(best.groupBy("e").count().where("count = 2").select("e.src", "e.dst", "e.key"))
        chosen.append(mutual)
        used = mutual.select(F.col("src").alias("id")).union(mutual.select("dst"))
        for end in ("src", "dst"):
            open_edges = dealt(open_edges, n, end).join(used.withColumnRenamed("id", end), end, "left_anti")
        open_edges = materialize(open_edges.select("src", "dst", "key"))
    return reduce(DataFrame.union, chosen) if chosen else edges.limit(0)


def greedy_weight_matching(g: Graph, weight="weight") -> DataFrame:
    """``src, dst, weight`` as taking edges by falling weight, then ``src, dst``, would give.

    Its weight is at least half the largest. Only weights over 0 are taken.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    rows = g.edges.select("src", "dst", w.alias("w")).where("w > 0")
    return _locally_best(rows.select("src", "dst", (-F.col("w")).alias("key"))).select("src", "dst", (-F.col("key")).alias("weight"))


def maximal_matching(g: Graph, cost=None) -> DataFrame:
    """``src, dst``: no further edge fits; cheapest first, else in the order of a hash. At least half as many edges as can be.

    There are as many rounds as the longest chain of ever cheaper neighbouring edges, a logarithm by hash.
    """
    c = F.xxhash64("src", "dst") if cost is None else F.col(cost) if isinstance(cost, str) else cost
    return _locally_best(g.edges.select("src", "dst", c.alias("key"))).select("src", "dst")


def check_matching(g: Graph, m: DataFrame, weight=None) -> DataFrame:
    """One row: ``edges, weight, missing`` (pairs that are no edge) and ``shared`` (vertices used twice)."""
    pairs = m.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    known = g.edges.select("src", "dst", w.alias("w"))
    total = pairs.join(known, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight"), F.count_if(F.col("w").isNull()).alias("missing"))
    ends = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).groupBy("id").count()
    return total.crossJoin(ends.agg(F.count_if(F.col("count") > 1).alias("shared")))


def bipartite_max_matching(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``left, right``: as many pairs as can be, from ``left, right`` edges.

    From a maximal matching, layers of alternating paths are searched from all
    free left vertices together; paths that end at free right vertices and share
    no vertex are turned over. It ends when no free right vertex is reached.
    """
    edges = materialize(edges.select("left", "right").distinct())
    tagged = edges.select(F.struct(F.lit(0).alias("side"), F.col("left").cast("string").alias("v")).alias("src"), F.struct(F.lit(1).alias("side"), F.col("right").cast("string").alias("v")).alias("dst"))
    first = _locally_best(tagged.withColumn("key", F.xxhash64("src", "dst")))
    kinds = dict(edges.dtypes)
    matched = materialize(first.select(F.col("src.v").cast(kinds["left"]).alias("left"), F.col("dst.v").cast(kinds["right"]).alias("right")))
    for _ in range(max_rounds):
        # layers: left vertices, the right ones next to them, and those's partners
        level = materialize(edges.select("left").distinct().join(matched, "left", "left_anti"))
        seen, steps, ends = None, [], None
        while level.limit(1).count():
            step = level.join(edges, "left").groupBy("right").agg(F.min("left").alias("left"))
            if seen is not None:
                step = step.join(seen, "right", "left_anti")
            step = materialize(step.join(matched.select("right", F.col("left").alias("mate")), "right", "left"))
            if step.limit(1).count() == 0:
                break
            steps.append(step)
            seen = step.select("right") if seen is None else materialize(seen.union(step.select("right")))
            if step.where("mate IS NULL").limit(1).count():
                ends = step.where("mate IS NULL")
                break
            level = step.select(F.col("mate").alias("left"))
        if ends is None:
            return matched
        # each path walks back to its root; of paths that meet, that with the least end goes on
        walk = ends.select(F.col("right").alias("path"), "right", "left")
        pairs = [materialize(walk.groupBy("left").agg(F.min(F.struct("path", "right")).alias("m")).select("m.path", "m.right", "left"))]
        for step in reversed(steps[:-1]):
            back = pairs[-1].select("path", F.col("left").alias("mate")).join(step, "mate").select("path", "right", "left")
            pairs.append(materialize(back.groupBy("left").agg(F.min(F.struct("path", "right")).alias("m")).select("m.path", "m.right", "left")))
        whole = pairs[-1].select("path")
        turned = materialize(reduce(DataFrame.union, pairs).join(whole, "path", "left_semi"))
        kept = matched.join(turned.select("right"), "right", "left_anti").join(turned.select("left"), "left", "left_anti")
        matched = materialize(kept.select("left", "right").union(turned.select("left", "right")))
    raise RuntimeError(f"no maximum in {max_rounds} rounds")


def bipartite_min_cost_assignment(edges: DataFrame, cost: str = "cost", max_rounds: int = 100_000) -> DataFrame:
    """``left, right, cost``: the most pairs, and of those the least total cost.

    Whole costs are taken as they are, others as decimals of 12 places, so that sums are exact; null costs are an error.

    Starts empty; each round finds, by least-cost search over the residual arcs
    from all free left vertices at once, the cheapest path to a free right
    vertex, and turns it over. Each turn adds one pair, and pairs so added are
    cheapest for their number; the paths of a round are found with joins.
    """
    asked = dict(edges.dtypes)[cost]
    kind = "bigint" if asked in ("tinyint", "smallint", "int", "bigint") else "decimal(30,12)"
    if edges.where(F.col(cost).isNull()).limit(1).count():
        raise ValueError("a cost is null")
    edges = materialize(edges.select("left", "right", F.col(cost).cast(kind).alias("cost")).groupBy("left", "right").agg(F.min("cost").alias("cost")))
    done = lambda m: m.withColumn("cost", F.col("cost").cast(asked))
    matched = edges.limit(0)
    for _ in range(max_rounds):
        matched = materialize(matched)
        free = edges.select("left").distinct().join(matched.select("left"), "left", "left_anti")
        open_edges = materialize(edges.join(matched.select("left", "right"), ["left", "right"], "left_anti"))
        best = front = materialize(free.select("left", F.lit(0).cast(kind).alias("d"), F.array().cast(_pairs_type(edges)).alias("path")))
        reached = None
        while front.limit(1).count():
            step = front.join(open_edges, "left").select("right", (F.col("d") + F.col("cost")).cast(kind).alias("d"), F.concat("path", F.array(F.struct("left", "right"))).alias("path"))
            step = step.groupBy("right").agg(F.min(F.struct("d", "path")).alias("m")).select("right", "m.d", "m.path")
            if reached is not None:
                step = step.union(reached).groupBy("right").agg(F.min(F.struct("d", "path")).alias("m")).select("right", "m.d", "m.path")
            reached = materialize(step)
            back = reached.join(matched.select("right", F.col("left"), F.col("cost")), "right").select("left", (F.col("d") - F.col("cost")).cast(kind).alias("d2"), F.col("path").alias("path2"))
            both = materialize(best.join(back, "left", "full").select("left", F.least("d", "d2").alias("d"), F.when(F.coalesce(F.col("d2") < F.col("d"), F.col("d").isNull()), F.col("path2")).otherwise(F.col("path")).alias("path"), F.coalesce(F.col("d2") < F.col("d"), F.col("d").isNull()).alias("new")))
            best, front = both.select("left", "d", "path"), both.where("new").select("left", "d", "path")
        if reached is None:
            return done(matched)
        end = reached.join(matched.select("right"), "right", "left_anti").orderBy("d", "right").limit(1)
        path = materialize(end.select(F.explode("path").alias("p")).select("p.left", "p.right"))
        if path.limit(1).count() == 0:
            return done(matched)
        kept = matched.join(path.select("left"), "left", "left_anti").join(path.select("right"), "right", "left_anti")
        matched = kept.select("left", "right", "cost").union(path.join(edges, ["left", "right"]).select("left", "right", "cost"))
    raise RuntimeError(f"no assignment in {max_rounds} rounds")


def _pairs_type(edges: DataFrame) -> str:
    kinds = dict(edges.dtypes)
    return f"array<struct<left:{kinds['left']},right:{kinds['right']}>>"
