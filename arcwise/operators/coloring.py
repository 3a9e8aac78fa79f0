"""Vertex colorings."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators.bundles import by_order, ends_in, neighbors, of_graph, unpacked
from arcwise.operators.graph import Graph
from arcwise.storage import materialize


def greedy_coloring(g: Graph, priority: DataFrame | None = None, fixed: DataFrame | None = None, max_colors: int | None = None) -> DataFrame | None:
    """``id, color`` from 0: each vertex takes the smallest color free of those before it.

    ``priority`` is ``id, rank`` (least first, ties by id; else by falling degree).
    Colors of ``fixed`` (``id, color``) stay. None if more than ``max_colors`` are
    needed. The number of colors is not the least in general. In each round all
    vertices that come before their uncolored neighbours are colored together; without ``priority`` and
    ``fixed``, small components are colored in their bundles.
    """
    if priority is None and fixed is None and (packed := of_graph(g)) is not None:
        return _with_bundles(g, packed, packed[0], _colors_in, lambda rest: greedy_coloring(rest, rest.degrees().select("id", (-F.col("degree")).alias("rank")), max_colors=max_colors), max_colors)
    rank = g.degrees().select("id", (-F.col("degree")).alias("rank")) if priority is None else priority
    place = materialize(g.vertices.join(rank, "id", "left").select("id", F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), "id").alias("p")))
    arcs = materialize(g.arcs.select("src", "dst"))
    done = materialize(g.vertices.join(fixed, "id").select("id", F.col("color").cast("int").alias("color")) if fixed is not None else place.select("id", F.lit(0).alias("color")).limit(0))
    left = materialize(place.join(done, "id", "left_anti"))
    while left.limit(1).count():
        near = arcs.join(left.select(F.col("id").alias("src"), F.col("p").alias("mine")), "src").join(left.select(F.col("id").alias("dst"), F.col("p").alias("theirs")), "dst")
        later = near.where("theirs < mine").select(F.col("src").alias("id")).distinct()
        now = left.join(later, "id", "left_anti").select("id")
        used = now.join(arcs.withColumnRenamed("src", "id"), "id", "left").join(done.select(F.col("id").alias("dst"), "color"), "dst", "left").groupBy("id").agg(F.collect_set("color").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        new = materialize(used.select("id", free.alias("color")))
        if max_colors is not None and new.where(F.col("color") >= max_colors).limit(1).count():
            return None
        done = materialize(done.union(new))
        left = materialize(left.join(new, "id", "left_anti"))
    return done


def _with_bundles(g: Graph, packed, bundles: DataFrame, f, other, max_colors: int | None = None) -> DataFrame | None:
    """Colors of small components by ``f``, of the others by ``other``."""
    kind = dict(g.vertices.dtypes)["id"]
    small = materialize(unpacked(bundles, f, "id long, color long").select(F.col("id").cast(kind).alias("id"), F.col("color").cast("int").alias("color")))
    if max_colors is not None and not small.where(F.col("color") >= max_colors).isEmpty():
        return None
    if packed[1] is None:
        return small
    large = other(packed[1])
    return None if large is None else small.union(large.select(F.col("id").cast(kind), "color"))


def _colors_in(x, backward: bool = False):
    """In a bundle: the smallest color free of the neighbours before, by falling degree and id, or from the last place of an order on."""
    ids = np.unique(np.concatenate([x["src"], x["dst"]]))
    a, b = ends_in(ids, x)
    if backward:  # vertices without a place count as place 0
        rank = np.zeros(len(ids), np.int64)
        rank[np.searchsorted(ids, x["ids"])] = -x["pos"]
    else:
        rank = -np.bincount(np.concatenate([a, b]), minlength=len(ids))
    near, color = neighbors(a, b, len(ids)), [-1] * len(ids)
    for v in np.argsort(rank, kind="stable").tolist():
        used, c = {color[u] for u in near[v]}, 0
        while c in used:
            c += 1
        color[v] = c
    return {"id": ids, "color": np.array(color)}


def chordal_coloring(g: Graph, order: DataFrame) -> DataFrame:
    """The least number of colors, given a perfect elimination order ``id, pos`` of a chordal graph."""
    if (packed := of_graph(g)) is not None:
        return _with_bundles(g, packed, by_order(g, order), partial(_colors_in, backward=True), lambda rest: greedy_coloring(rest, order.select("id", (-F.col("pos")).alias("rank"))))
    return greedy_coloring(g, order.select("id", (-F.col("pos")).alias("rank")))


def check_coloring(g: Graph, coloring: DataFrame) -> DataFrame:
    """One row: ``conflicts``, ``missing`` vertices, and ``colors`` used."""
    c = coloring.select("id", "color")
    both = g.edges.select("src", "dst").join(c.toDF("src", "a"), "src", "left").join(c.toDF("dst", "b"), "dst", "left")
    conflicts = both.agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))
    missing = g.vertices.join(c, "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return conflicts.crossJoin(missing).crossJoin(c.agg(F.countDistinct("color").alias("colors")))


def color_with_tree(g: Graph, colors: int, nice: DataFrame, max_rows: int = 10_000_000) -> DataFrame | None:
    """``id, color`` with ``colors`` colors or None: exact, by tables over a nice tree.

    ``nice`` is ``node_id, parent_id, op, vertex`` (op: leaf, introduce, forget,
    join). From the lowest nodes up, each node's table holds the proper colorings of its bag that
    extend downwards, as sorted ``(vertex, color)`` lists; from the root down one
    of each is chosen. A table has ``colors ** (width + 1)`` rows at most.
    """
    nice = materialize(nice.select("node_id", "parent_id", "op", "vertex"))
    palette = F.sequence(F.lit(0), F.lit(colors - 1))
    near = materialize(g.arcs.groupBy(F.col("src").alias("vertex")).agg(F.collect_set("dst").alias("near")))
    # height: leaves 0
    height = materialize(nice.where("op = 'leaf'").select("node_id", F.lit(0).alias("height")))
    levels, front, h = [height.select("node_id")], height, 0
    known = height
    up = nice.select("node_id", "parent_id").where("parent_id IS NOT NULL")
    while True:
        h += 1
        step = front.join(up, "node_id").select(F.col("parent_id").alias("node_id")).distinct().withColumn("height", F.lit(h))
        front = materialize(step)
        if front.limit(1).count() == 0:
            break
        known = materialize(known.union(front).groupBy("node_id").agg(F.max("height").alias("height")))
    nodes = materialize(nice.join(known, "node_id"))
    top = nodes.agg(F.max("height")).first()[0]
    pair = F.struct("vertex", F.col("color").cast("int").alias("color"))
    tables, parts = None, {}
    for h in range(top + 1):
        here = nodes.where(F.col("height") == h).drop("height")
        made = here.where("op = 'leaf'").select("node_id", "vertex", F.explode(palette).alias("color")).select("node_id", F.array(pair).alias("bag"))
        if tables is not None:
            kids = here.where("op <> 'leaf'").join(nice.select(F.col("node_id").alias("kid"), F.col("parent_id").alias("node_id")), "node_id").join(tables.select(F.col("node_id").alias("kid"), "bag"), "kid")
            intro = kids.where("op = 'introduce'").join(near, "vertex", "left").withColumn("color", F.explode(palette))
            clash = F.exists("bag", lambda x: F.array_contains(F.coalesce("near", F.array().cast(dict(near.dtypes)["near"])), x["vertex"]) & (x["color"] == F.col("color")))
            intro = intro.where(~clash).select("node_id", F.array_sort(F.concat("bag", F.array(pair))).alias("bag"))
            forget = kids.where("op = 'forget'").select("node_id", F.filter("bag", lambda x: x["vertex"] != F.col("vertex")).alias("bag")).distinct()
            join = kids.where("op = 'join'").groupBy("node_id", "bag").agg(F.countDistinct("kid").alias("n")).where("n = 2").select("node_id", "bag")
            made = made.union(intro).union(forget).union(join)
        made = materialize(made)
        if made.count() > max_rows:
            raise ValueError("a table is over max_rows; the tree is too wide")
        if here.join(made.select("node_id").distinct(), "node_id", "left_anti").limit(1).count():
            return None
        tables = made if tables is None else tables.union(made)
        parts[h] = made
    # down again: the least row of each node that agrees with its parent's choice
    chosen = materialize(parts[top].groupBy("node_id").agg(F.min("bag").alias("bag")))
    picked = chosen
    for _ in range(top):
        below = nice.select("node_id", "parent_id", "op", "vertex").join(chosen.select(F.col("node_id").alias("parent_id"), F.col("bag").alias("above")), "parent_id")
        fits = below.join(tables, "node_id")
        agree = F.forall("bag", lambda x: ~F.exists("above", lambda y: (y["vertex"] == x["vertex"]) & (y["color"] != x["color"])))
        chosen = materialize(fits.where(agree).groupBy("node_id").agg(F.min("bag").alias("bag")))
        if chosen.limit(1).count() == 0:
            break
        picked = picked.union(chosen)
    return picked.select(F.explode("bag").alias("x")).select(F.col("x.vertex").alias("id"), F.col("x.color").alias("color")).groupBy("id").agg(F.min("color").alias("color"))


def chromatic_number(g: Graph, nice: DataFrame, most: int = 64) -> int:
    """The least number of colors with which ``color_with_tree`` succeeds; 0 for no vertices."""
    if g.vertices.limit(1).count() == 0:
        return 0
    for k in range(1, most + 1):
        if color_with_tree(g, k, nice) is not None:
            return k
    raise ValueError(f"more than {most} colors")
