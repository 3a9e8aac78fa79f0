"""Spanning trees, matchings and tours over points of the plane, without an edge for every pair.

Pairs are searched by a grid whose cells grow: at a length h all pairs up to h lie in the same or in neighbouring cells. What is
found up to h is final before h grows, so nothing shorter is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.functions.geometry import euclidean
from arcwise.functions.ranking import with_global_index
from arcwise.operators.components import star_labels
from arcwise.operators.graph import Graph
from arcwise.operators.matching import maximal_matching
from arcwise.operators.multigraph import MultiGraph
from arcwise.operators.paths import minimum_spanning_forest
from arcwise.operators.tours import eulerian_circuit
from arcwise.storage import forget, materialize

#: Points of different places that a cell of the first grid may hold.
CROWD = 16


def _cell(h: float) -> list:
    # a little wider, so that rounding puts no pair of length h two cells apart
    return [F.floor(F.col(c) / (h * (1 + 1e-9))).cast("long").alias(f"c{c}") for c in ("x", "y")]


def _around(both_ways: bool) -> F.Column:
    """Offsets of the neighbouring cells and the own one; without ``both_ways`` each two neighbours once."""
    spots = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if both_ways or (i, j) >= (0, 0)]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spots)))


def close_pairs(points: DataFrame, h: float) -> DataFrame:
    """``a, b, ga, gb, d``: all pairs of ``id, x, y, g`` of different ``g`` that are at most ``h`` apart, each once with a < b.

    Only cells near which there are points of two groups are joined.
    """
    placed = points.select("id", "x", "y", "g", *_cell(h))
    seen = placed.groupBy("cx", "cy").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).select("*", _around(True).alias("o"))
    seen = seen.groupBy((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    live = placed.join(seen.where("lo <> hi").select("cx", "cy"), ["cx", "cy"], "left_semi")
    one = live.select(F.col("id").alias("a"), F.col("g").alias("ga"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy")
    other = live.select(F.col("id").alias("b"), F.col("g").alias("gb"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy", _around(False).alias("o"))
    other = other.select("b", "gb", "xb", "yb", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("o.i") == 0).alias("si"), (F.col("o.j") == 0).alias("sj"))
    met = one.join(other, ["cx", "cy"]).where("ga <> gb AND (NOT (si AND sj) OR a < b)").withColumn("d", euclidean("xa", "ya", "xb", "yb")).where(F.col("d") <= h)
    turn = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(name)
    return met.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("ga", "gb", "ga"), pick("gb", "ga", "gb"), "d")


def _next_length(points: DataFrame, h: float) -> float:
    """The first of ``h``, 4 ``h``, 16 ``h`` and so on at which points of two groups come into neighbouring cells."""
    while True:
        seen = points.groupBy(*_cell(h)).agg(F.min("g").alias("lo"), F.max("g").alias("hi")).select("*", _around(True).alias("o"))
        seen = seen.groupBy(F.col("cx") + F.col("o.i"), F.col("cy") + F.col("o.j")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        if not seen.where("lo <> hi").isEmpty():
            return h
        h *= 4


def _checked(points: DataFrame) -> tuple[DataFrame, float]:
    """Places (the least id of each), and a first length at which no cell is crowded."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cast = points.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y")))
    places = materialize(cast.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"), "places")
    bad = F.count_if(~(finite("x") & finite("y")) | F.col("id").isNull())
    row = places.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y"))).first()
    if row["bad"]:
        raise ValueError("points need an id and finite coordinates")
    if row["n"] < 2:
        return places, 1.0
    wide, high = row["max_x"] - row["min_x"], row["max_y"] - row["min_y"]
    h = max(wide, high) / row["n"] ** 0.5
    while h > max(wide, high) / 1e9 and not places.groupBy(*_cell(h)).count().where(F.col("count") > CROWD).isEmpty():
        h /= 2
    return places, h


def spanning_tree_of_points(points: DataFrame) -> DataFrame:
    """``src, dst, cost``: the shortest tree over ``id, x, y``; equal lengths go by ids.

    At each length, groups that have come together so far are linked by the shortest pairs between them and a spanning forest of
    these is taken; then the length grows. Pairs inside a group are never made, but where two groups come into
    neighbouring cells, their points there are all compared. Points of one place hang on its least id. Ids are each once;
    null ids and coordinates that are null or not finite are an error.
    """
    places, h = _checked(points)
    same = points.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y"))).join(places.select(F.col("id").alias("at"), "x", "y"), ["x", "y"]).where("id <> at")
    picked = [same.select(F.col("at").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost"))]
    now = materialize(places.select("id", "x", "y", F.col("id").alias("g")), "grouped")
    open_groups = now.count()
    while open_groups > 1:
        h = _next_length(now, h)
        pairs = close_pairs(now, h)
        links = pairs.groupBy(F.least("ga", "gb").alias("src"), F.greatest("ga", "gb").alias("dst")).agg(F.min(F.struct("d", "a", "b")).alias("cost"))
        links = materialize(links, "links")
        if links.limit(1).count():
            ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
            chosen = materialize(minimum_spanning_forest(Graph(ends, links)), "chosen")
            picked.append(chosen.select("cost.a", "cost.b", "cost.d"))
            merged = star_labels(chosen.select("src", "dst")).select(F.col("id").alias("g"), "component")
            moved = materialize(now.join(merged, "g", "left").select("id", "x", "y", F.coalesce("component", "g").alias("g")), "grouped")
            forget(now)
            now = moved
            open_groups -= chosen.count()
        forget(links)
        h *= 4
    return reduce(DataFrame.union, picked).toDF("src", "dst", "cost")


def greedy_matching_of_points(points: DataFrame) -> DataFrame:
    """``src, dst, cost``: pairs of ``id, x, y``, shortest first, then by ids, until at most one point is left.

    No two points left are within the length done, so after the first grid a cell holds a few points at most.
    """
    places, h = _checked(points)
    left = materialize(points.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y")), F.col("id").alias("g")), "left")
    picked, n = [], left.count()
    # points of one place first: each with the next
    at = with_global_index(left, ["x", "y", "id"], "i")
    first = at.groupBy("x", "y").agg(F.min("i").alias("f"))
    turn = at.join(first, ["x", "y"]).select("id", "x", "y", F.floor((F.col("i") - F.col("f")) / 2).alias("p"))
    pairs = materialize(turn.groupBy("x", "y", "p").agg(F.min("id").alias("src"), F.max("id").alias("dst")).where("src <> dst").select("src", "dst", F.lit(0.0).alias("cost")), "same")
    while True:
        picked.append(pairs)
        used = pairs.select(F.col("src").alias("id")).union(pairs.select("dst"))
        rest = materialize(left.join(used, "id", "left_anti"), "left")
        forget(left)
        left = rest
        n -= 2 * pairs.count()
        if n < 2:
            return reduce(DataFrame.union, picked)
        h = _next_length(left, h)
        near = materialize(close_pairs(left, h).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("d").alias("cost")), "near")
        h *= 4
        pairs = materialize(near.join(maximal_matching(Graph(left.select("id"), near), "cost"), ["src", "dst"]), "pairs")
        forget(near)


def tour_of_points(points: DataFrame, method: str = "greedy_match") -> DataFrame:
    """``step, id``: a closed tour of ``id, x, y``, ending where it starts.

    ``double_tree`` walks the spanning tree twice and is at most twice as long as the shortest tour; ``greedy_match`` adds
    the greedy matching of the tree's odd points, without such a bound. No points: no rows; one: its own step and back.
    """
    ids = points.select("id").distinct()
    few = ids.limit(2).count()
    if few < 2:
        return ids.select(F.lit(0).alias("step"), "id").union(ids.select(F.lit(1), "id"))
    tree = materialize(spanning_tree_of_points(points), "tree")
    if method == "double_tree":
        walked = MultiGraph.from_edges(tree.select("src", "dst", F.lit(2).alias("count")))
    elif method == "greedy_match":
        odd = Graph(ids, tree).odd_vertices()
        added = greedy_matching_of_points(points.join(odd, "id", "left_semi"))
        walked = MultiGraph.from_edges(tree.select("src", "dst").union(added.select("src", "dst")))
    else:
        raise ValueError(method)
    seen = eulerian_circuit(walked).groupBy("id").agg(F.min("step").alias("at"))
    tour = materialize(with_global_index(seen, ["at"], "step").select(F.col("step").cast("int").alias("step"), "id"), "tour")
    return tour.union(tour.where("step = 0").crossJoin(tour.agg(F.count(F.lit(1)).cast("int").alias("n"))).select("n", "id"))
