"""Elimination orders, chordal completion and tree decompositions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.operators.bundles import by_order, ends_in, neighbors, of_graph, repacked, roots_of, unpacked
from arcwise.operators.components import star_labels
from arcwise.operators.connectivity import component_count, parents_in_tree
from arcwise.operators.graph import Graph
from arcwise.storage import dealt, materialize, parts_for, rows_of


def _later(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``v, pv, u, pu``: the end that goes first, and the other."""
    a, b = order.select(F.col("id").alias("src"), F.col("pos").alias("ps")), order.select(F.col("id").alias("dst"), F.col("pos").alias("pd"))
    n = rows_of(edges)
    both = dealt(dealt(edges.select("src", "dst"), n, "src").join(a, "src"), n, "dst").join(b, "dst")
    first = F.col("ps") < F.col("pd")
    return both.select(
        F.when(first, F.col("src")).otherwise(F.col("dst")).alias("v"), F.least("ps", "pd").alias("pv"),
        F.when(first, F.col("dst")).otherwise(F.col("src")).alias("u"), F.greatest("ps", "pd").alias("pu"),
    )


def _owed(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs that an elimination needs as edges, which may repeat: a vertex's next later neighbour with its other later ones."""
    later = materialize(_later(edges, order))
    later = dealt(later, rows_of(later), "v")
    nxt = later.groupBy("v").agg(F.min_by("u", "pu").alias("n"))
    return later.join(nxt, "v").where("u <> n").select(F.least("u", "n").alias("src"), F.greatest("u", "n").alias("dst"))


def _later_in(x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In a bundle: the places in its ids of the end that goes first and the other, in their order, and whether that is the next one."""
    a, b = ends_in(x["ids"], x)
    first = x["pos"][a] < x["pos"][b]
    v, u = np.where(first, a, b), np.where(first, b, a)
    by = np.lexsort((x["pos"][u], v))
    v, u = v[by], u[by]
    return v, u, np.r_[True, v[1:] != v[:-1]][: len(v)]


def _broken_in(x):
    """In a bundle: how many of the pairs that an elimination needs are no edges."""
    v, u, nxt = _later_in(x)
    n = u[nxt][np.cumsum(nxt) - 1]
    key = lambda p, q: np.minimum(p, q) * len(x["ids"]) + np.maximum(p, q)
    return {"bad": np.array([(~np.isin(key(u, n)[~nxt], key(v, u))).sum()])}


def is_elimination_order(g: Graph, order: DataFrame) -> bool:
    """Whether ``id, pos`` is a perfect elimination order. Small components are checked in their bundles."""
    packed = of_graph(g)
    if packed is not None:
        if unpacked(by_order(g, order), _broken_in, "bad long").agg(F.sum("bad")).first()[0]:
            return False
        if packed[1] is None:
            return True
        g = packed[1]
    n = rows_of(g.edges)
    owed = dealt(_owed(g.edges, order), n, "src", "dst")
    return owed.join(dealt(g.edges.select("src", "dst"), n, "src", "dst"), ["src", "dst"], "left_anti").isEmpty()


def perfect_elimination_order(g: Graph) -> DataFrame | None:
    """``id, pos`` or None if the graph is not chordal.

    In each round all vertices whose neighbours are all linked go; they may go
    together, as such a vertex stays one in what is left. Small components have their rounds in their bundles.
    """
    done, turn, kind = [], 0, dict(g.vertices.dtypes)["id"]
    if (packed := of_graph(g)) is not None:
        small = materialize(unpacked(packed[0], _turns_in, "id long, turn long"))
        if not small.where("turn < 0").isEmpty():
            return None
        done.append(small.select(F.col("id").cast(kind).alias("id"), F.col("turn").cast("int").alias("turn")))
        g = packed[1] or Graph(g.vertices.limit(0), g.edges.limit(0))
    left, edges = materialize(g.vertices), materialize(g.edges.select("src", "dst"))
    while left.limit(1).count():
        arcs = edges.union(edges.select("dst", "src").toDF("src", "dst"))
        degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        a, b = arcs.toDF("id", "x"), arcs.toDF("id", "y")
        linked = a.join(b, "id").where("x < y").join(edges.toDF("x", "y"), ["x", "y"]).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
        counts = left.join(degree, "id", "left").join(linked, "id", "left").fillna(0, ["d", "t"])
        now = materialize(counts.where("2 * t = d * (d - 1)").select("id", F.lit(turn).alias("turn")))
        if now.limit(1).count() == 0:
            return None
        done.append(now)
        rest = Graph(left, edges).remove_vertices(now.select("id"))
        left, edges, turn = materialize(rest.vertices), materialize(rest.edges), turn + 1
    if not done:
        return g.vertices.select("id", F.lit(0).cast("long").alias("pos"))
    return with_global_index(reduce(DataFrame.union, done), ["turn", "id"], "pos", parts_for(g.vertices.sparkSession, rows_of(done[0]) or 0)).select("id", "pos")


def _turns_in(x):
    """In a bundle: the round in which each vertex goes, less than 0 if it never does."""
    ids = np.unique(np.concatenate([x["src"], x["dst"]]))
    near = [set(v) for v in neighbors(*ends_in(ids, x), len(ids))]
    turn, asked, now = [-1] * len(ids), range(len(ids)), 0
    while asked:
        go = [v for v in asked if len(near[v]) < 2 or all(near[v] - near[u] == {u} for u in near[v])]
        again = set()
        for v in go:
            turn[v] = now
        for v in go:
            for u in near[v]:
                near[u].discard(v)
                if turn[u] < 0:
                    again.add(u)
        asked, now = again, now + 1
    return {"id": ids, "turn": np.array(turn)}


def is_chordal(g: Graph) -> bool:
    return perfect_elimination_order(g) is not None


def low_degree_order(g: Graph) -> DataFrame:
    """``id, pos`` by degree, then id."""
    n = rows_of(g.vertices)
    return with_global_index(g.degrees(), ["degree", "id"], "pos", n and parts_for(g.vertices.sparkSession, n)).select("id", "pos")


def chordal_completion(g: Graph, order: DataFrame | None = None) -> Graph:
    """The graph with the edges that eliminating in the order (else by degree) fills in; not the fewest.

    Small components are filled in their bundles, which the new graph keeps.
    """
    order = materialize(low_degree_order(g) if order is None else order) if getattr(order, "written_to", None) is None else order
    packed = of_graph(g)
    if packed is None:
        return Graph(g.vertices, _filled(g.edges, order))
    full = repacked(by_order(g, order), ["src", "dst", "ids", "pos"], _filled_in, "filled")
    small, rest = unpacked(full, lambda x: {"src": x["src"], "dst": x["dst"]}, "src long, dst long").where("src <> dst"), packed[1]
    kind = dict(g.edges.dtypes)
    edges = small
    if rest is not None:
        more = _filled(rest.edges, order)
        edges, rest = small.union(more), Graph(rest.vertices, more)
    done = Graph(g.vertices, edges.select(*[F.col(c).cast(kind[c]).alias(c) for c in ("src", "dst")]))
    done.packed, done.ordered = (full.select("chunk", "src", "dst"), rest), (order, full)
    return done


def _filled(edges: DataFrame, order: DataFrame) -> DataFrame:
    edges = materialize(edges.select("src", "dst"))
    while True:
        more = materialize(_owed(edges, order).distinct().join(edges, ["src", "dst"], "left_anti"))
        if more.limit(1).count() == 0:
            return edges
        edges = materialize(edges.union(more))


def _filled_in(x, most: int = 200_000):
    """Bundles of some ``most`` edges of what eliminating a bundle's vertices in their order fills in; edges of vertices without a place stay."""
    ids, pos = x["ids"], x["pos"]
    a, b = ends_in(ids, x)
    root = roots_of(a, b, len(ids))
    turn = np.lexsort((pos, root))
    rank = np.empty(len(ids), np.int64)
    rank[turn] = np.arange(len(ids))
    low, high = np.minimum(rank[a], rank[b]).tolist(), np.maximum(rank[a], rank[b]).tolist()
    later = [set() for _ in range(len(ids))]
    for v, u in zip(low, high, strict=True):
        later[v].add(u)
    top, vs, us, start = root[turn].tolist(), [], [], 0
    for v, after in enumerate(later):
        if len(after) > 1:
            n = min(after)
            later[n] |= after
            later[n].discard(n)
        vs += [v] * len(after)
        us += after
        last = v + 1 == len(top)
        if last or (len(vs) > most and top[v + 1] != top[v]):
            one, two = ids[turn[np.array(vs, np.int64)]], ids[turn[np.array(us, np.int64)]]
            here = np.sort(turn[start : v + 1])
            own = ids[here]
            # vertices alone, and in the last bundle what has no place
            alone = np.setdiff1d(own, np.concatenate([one, two]), assume_unique=False)
            out = {"src": np.concatenate([np.minimum(one, two), alone]), "dst": np.concatenate([np.maximum(one, two), alone]), "ids": own, "pos": pos[here]}
            yield out
            vs, us, start, later[start : v + 1] = [], [], v + 1, [()] * (v + 1 - start)


def chordal_tree_decomposition(g: Graph, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``(bag_id, vertex)`` and tree edges ``src, dst`` between bags, or None if not chordal.

    A vertex's bag is itself and its later neighbours; it hangs on the bag of the
    next of these. The last bags of the components hang on each other in a heap, so the tree stays shallow.
    """
    order = perfect_elimination_order(g) if order is None else order
    if order is None or not is_elimination_order(g, order):
        return None
    packed, kind = of_graph(g), dict(g.vertices.dtypes)["id"]
    if packed is not None:
        valued = by_order(g, order)
        later = unpacked(valued, lambda x: dict(zip(("v", "u", "nxt"), [x["ids"][c] for c in _later_in(x)[:2]] + [_later_in(x)[2].astype(np.int64)], strict=True)), "v long, u long, nxt long")
        roots = unpacked(valued, lambda x: {"id": np.delete(x["ids"], np.unique(_later_in(x)[0]))}, "id long")
        later, rest = later.select(F.col("v").cast(kind).alias("v"), F.col("u").cast(kind).alias("u"), "nxt"), packed[1]
        hang = later.where("nxt = 1").select(F.col("v").alias("src"), F.col("u").alias("dst"))
    if packed is None or rest is not None:
        whole = g if packed is None else rest
        more = materialize(_later(whole.edges, order))
        hung = more.groupBy(F.col("v").alias("src")).agg(F.min_by("u", "pu").alias("dst"))
        tops = whole.vertices.join(hung, F.col("id") == F.col("src"), "left_anti").select("id")
        if packed is None:
            later, hang, roots = more.select("v", "u"), hung, tops
        else:
            later, hang, roots = later.select("v", "u").union(more.select("v", "u")), hang.union(hung), roots.union(tops)
    bags = g.vertices.select(F.col("id").alias("bag_id"), F.col("id").alias("vertex")).union(later.select("v", "u"))
    placed = materialize(with_global_index(roots.select(F.col("id").cast(kind).alias("id")), ["id"], "at"))
    above = placed.select(F.col("at").alias("up"), F.col("id").alias("dst"))
    strung = placed.where("at > 0").withColumn("up", F.floor((F.col("at") - 1) / 2)).join(above, "up").select(F.col("id").alias("src"), "dst")
    tree = hang.union(strung).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return bags, tree


def tree_width(bags: DataFrame) -> int:
    return (bags.groupBy("bag_id").count().agg(F.max("count")).first()[0] or 0) - 1


def check_decomposition(g: Graph, bags: DataFrame, tree: DataFrame) -> DataFrame:
    """One row of faults: uncovered vertices and edges, vertices whose bags don't hang together, and whether ``tree`` is one."""
    spark = bags.sparkSession
    v = g.vertices.join(bags.select(F.col("vertex").alias("id")), "id", "left_anti").count()
    a, b = bags.select("bag_id", F.col("vertex").alias("src")), bags.select("bag_id", F.col("vertex").alias("dst"))
    # pairs repeat where bags do, and are not grouped for the test
    e = g.edges.select("src", "dst").join(a.join(b, "bag_id").where("src < dst").select("src", "dst"), ["src", "dst"], "left_anti").count()
    nodes = bags.select(F.col("bag_id").alias("id")).distinct()
    n, hung = nodes.count(), Graph(nodes, tree)
    is_tree = n == 0 or (hung.edge_count() == n - 1 and component_count(hung) == 1)
    homes = bags.select("bag_id", "vertex").distinct()
    kept = tree.join(homes.select(F.col("bag_id").alias("src"), "vertex"), "src").join(homes.select(F.col("bag_id").alias("dst"), "vertex"), ["dst", "vertex"])
    if is_tree:
        # a part of a tree has as many components as it has more nodes than edges
        more = homes.select("vertex", F.lit(1).alias("n")).union(kept.select("vertex", F.lit(-1)))
        parted = more.groupBy("vertex").agg(F.sum("n").alias("n")).where("n > 1").count()
    else:
        key = lambda c: F.struct("vertex", F.col(c).alias("bag"))
        labels = star_labels(kept.select(key("src").alias("src"), key("dst").alias("dst")))
        named = homes.select("vertex", key("bag_id").alias("id")).join(labels, "id", "left").select("vertex", F.coalesce("component", "id").alias("c"))
        parted = named.groupBy("vertex").agg(F.countDistinct("c").alias("n")).where("n > 1").count()
    return spark.createDataFrame([(v, e, parted, is_tree)], "vertices long, edges long, parted long, is_tree boolean")


def nice_tree(bags: DataFrame, tree: DataFrame) -> DataFrame:
    """``node_id, parent_id, op, vertex``: leaves of one vertex, one vertex introduced or forgotten a step, joins of two.

    The root is the largest bag. Toward its parent a bag forgets what the parent
    lacks and takes in what it lacks; equal bags forget and take in one vertex. Several
    children meet in a heap of joins: of c children, join k hangs on join k / 2.
    """
    sets = materialize(dealt(bags, rows_of(bags), "bag_id").groupBy("bag_id").agg(F.array_sort(F.collect_set("vertex")).alias("bag")))
    root = sets.orderBy(F.desc(F.size("bag")), "bag_id").first()
    if root is None:
        raise ValueError("no bags")
    rooted = parents_in_tree(Graph(sets.select(F.col("bag_id").alias("id")), tree), root["bag_id"])
    if rooted is None:
        raise ValueError("the bags hang on no tree")
    kids = rooted.select(F.col("id").alias("y"), F.col("parent").alias("x"))
    ranked = kids.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("y")) - 1).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("x")))
    pairs = ranked.join(sets.toDF("y", "by"), "y").join(sets.toDF("x", "bx"), "x")
    same = F.col("by") == F.col("bx")
    forget = F.when(same, F.slice("by", 1, 1)).otherwise(F.array_except("by", "bx"))
    intro = F.when(same, F.slice("bx", 1, 1)).otherwise(F.array_except("bx", "by"))
    steps = F.concat(F.transform(forget, lambda v: F.struct(F.lit("forget").alias("op"), v.alias("vertex"))), F.transform(intro, lambda v: F.struct(F.lit("introduce").alias("op"), v.alias("vertex"))))
    pairs = materialize(pairs.select("x", "y", "r", "c", steps.alias("steps")))
    name = lambda bag, kind, k: F.concat_ws("|", bag.cast("string"), F.lit(kind), k.cast("string"))
    above = lambda bag: F.when(bag == F.lit(root["bag_id"]), F.lit(None).cast("string")).otherwise(name(bag, "e", F.lit(1)))
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    chain = pairs.select("x", "y", "r", "c", F.size("steps").alias("n"), F.posexplode("steps").alias("at", "s")).withColumn("k", F.col("at") + 1)
    port = F.when(F.col("c") == 1, above(x)).otherwise(name(x, "j", F.floor((F.col("c") + F.col("r")) / 2)))
    edges = chain.select(name(y, "e", k).alias("node_id"), F.when(k < F.col("n"), name(y, "e", k + 1)).otherwise(port).alias("parent_id"), "s.op", "s.vertex")
    joins = ranked.where("c > 1").select("x", "c").distinct().select("x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c") - 1)).alias("k"))
    kind = dict(bags.dtypes)["vertex"]
    joins = joins.select(name(x, "j", k).alias("node_id"), F.when(k > 1, name(x, "j", F.floor(k / 2))).otherwise(above(x)).alias("parent_id"), F.lit("join").alias("op"), F.lit(None).cast(kind).alias("vertex"))
    lone = sets.join(kids.select(F.col("x").alias("bag_id")), "bag_id", "left_anti").select(F.col("bag_id").alias("x"), F.size("bag").alias("n"), F.posexplode("bag").alias("at", "vertex")).withColumn("k", F.col("at") + 1)
    leaves = lone.select(name(x, "l", k).alias("node_id"), F.when(k < F.col("n"), name(x, "l", k + 1)).otherwise(above(x)).alias("parent_id"), F.when(k == 1, "leaf").otherwise("introduce").alias("op"), "vertex")
    return edges.union(joins).union(leaves)


