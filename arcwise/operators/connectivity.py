"""Components, contraction, reachability, bridges, blocks and separators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators.bundles import WHOLE, ends_in, in_ranges, of_graph, unpacked
from arcwise.operators.components import star_labels
from arcwise.operators.forests import preorder, range_extremes
from arcwise.operators.graph import Graph, canonical
from arcwise.operators.paths import rooted_spanning_forest
from arcwise.storage import dealt, forget, materialize, rows_of


def connected_components(g: Graph) -> DataFrame:
    """``id, component``: the smallest id that edges lead to."""
    labels = star_labels(g.edges)
    return g.vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_count(g: Graph) -> int:
    """How many components; 1 for the empty graph."""
    return max(1, connected_components(g).select("component").distinct().count())


def disjoint_sets(values: DataFrame, pairs: DataFrame, include_single: bool = True) -> DataFrame:
    """``id, set_id`` after merging by pairs ``src, dst``; values alone in their set may be left out."""
    real = pairs.where("src <> dst")
    ends = real.select(F.col("src").alias("id")).union(real.select("dst")).union(values.select(values.columns[0])).distinct()
    sets = connected_components(Graph(ends, canonical(real.select("src", "dst")).distinct())).withColumnRenamed("component", "set_id")
    if include_single:
        return sets
    size = sets.groupBy("set_id").count().where("count > 1")
    return sets.join(size, "set_id", "left_semi").select("id", "set_id")


def contract(g: Graph, pairs: DataFrame) -> tuple[DataFrame, Graph, DataFrame]:
    """Merge along edges: ``(id, group_id)``, the graph of groups, and the old
    edges of each new one (``src, dst, old_src, old_dst``). Edges inside a group go."""
    groups = materialize(disjoint_sets(g.vertices, pairs).withColumnRenamed("set_id", "group_id"))
    a, b = (groups.select(F.col("id").alias(end), F.col("group_id").alias(f"_{end}")) for end in ("src", "dst"))
    moved = g.edges.join(a, "src").join(b, "dst").where("_src <> _dst")
    old = moved.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"), F.col("src").alias("old_src"), F.col("dst").alias("old_dst"))
    return groups, Graph(groups.select(F.col("group_id").alias("id")).distinct(), old.select("src", "dst").distinct()), old


def reachable_from(g_or_arcs, sources: DataFrame, max_rounds: int = 100_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """``id, hops, parent`` of what the sources reach; the parent is the smallest of the round before.

    With ``keys`` the arcs and sources carry those columns, and each key's arcs
    are searched by themselves in the same rounds.
    """
    arcs = g_or_arcs.arcs if isinstance(g_or_arcs, Graph) else g_or_arcs
    k = list(keys)
    arcs = materialize(arcs.select(*k, "src", "dst").distinct())
    kind = dict(arcs.dtypes)["src"]
    front = materialize(sources.select(*k, F.col(next(c for c in sources.columns if c not in k)).alias("id")).distinct().select(*k, "id", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent")))
    seen, layers = front.select(*k, "id"), [front]
    for hops in range(1, max_rounds):
        step = front.select(*k, F.col("id").alias("src")).join(arcs, [*k, "src"]).groupBy(*k, F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = materialize(step.join(seen, [*k, "id"], "left_anti").select(*k, "id", F.lit(hops).alias("hops"), "parent"))
        if front.limit(1).count() == 0:
            return reduce(DataFrame.union, layers)
        layers.append(front)
        seen = reduce(DataFrame.union, [x.select(*k, "id") for x in layers])
        if hops % 20 == 0:  # one table in place of many
            layers = [materialize(reduce(DataFrame.union, layers))]
            seen = layers[0].select(*k, "id")
    raise RuntimeError(f"not all was reached in {max_rounds} rounds")


def _low_high(g: Graph) -> DataFrame:
    """``id, parent, pre, size, low, high`` of a spanning forest: the extreme numbers that a subtree's edges off the tree reach."""
    order = preorder(*rooted_spanning_forest(g))
    ends = g.edges.join(order.select(F.col("id").alias("src"), F.col("pre").alias("ps"), F.col("parent").alias("us")), "src")
    ends = ends.join(order.select(F.col("id").alias("dst"), F.col("pre").alias("pd"), F.col("parent").alias("ud")), "dst")
    off = ends.where(~(F.coalesce(F.col("us") == F.col("dst"), F.lit(False)) | F.coalesce(F.col("ud") == F.col("src"), F.lit(False))))
    far = off.select(F.col("ps").alias("pre"), F.col("pd").alias("to")).union(off.select("pd", "ps"))
    far = far.groupBy("pre").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    own = order.join(far, "pre", "left").select("pre", "size", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    return materialize(order.join(range_extremes(own), "pre").select("id", "parent", "pre", "size", "low", "high"))


def blocks_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The block of each edge ``a, b`` between numbers below ``n``, as a vertex that is the lower end of only that block's first edge."""
    m = len(a)
    start, end, edge = np.concatenate([a, b]), np.concatenate([b, a]).tolist(), np.concatenate([np.arange(m)] * 2).tolist()
    order = np.argsort(start, kind="stable").tolist()
    at = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))]).tolist()
    stop, pre, low, above, block, held, turn = at[1:], [-1] * n, [0] * n, [-1] * n, [-1] * m, [], 0
    for top in range(n):
        if pre[top] >= 0:
            continue
        pre[top] = low[top] = turn
        turn, way = turn + 1, [top]
        while way:
            v = way[-1]
            if at[v] < stop[v]:
                k = order[at[v]]
                at[v] += 1
                u, e = end[k], edge[k]
                if pre[u] < 0:
                    above[u] = e
                    pre[u] = low[u] = turn
                    turn += 1
                    held.append(e)
                    way.append(u)
                elif e != above[v] and pre[u] < pre[v]:
                    held.append(e)
                    low[v] = min(low[v], pre[u])
                continue
            way.pop()
            if not way:
                break
            p = way[-1]
            if low[v] < pre[p]:
                low[p] = min(low[p], low[v])
                continue
            while block[above[v]] < 0:
                block[held.pop()] = v
    return np.array(block, np.int64)


def _blocks_in(x):
    """In a bundle: its edges with their blocks."""
    ids = np.unique(np.concatenate([x["src"], x["dst"]]))
    a, b = ends_in(ids, x)
    return {"src": ids[a], "dst": ids[b], "block": ids[blocks_of(a, b, len(ids))]}


def biconnected_components(g: Graph) -> DataFrame:
    """``src, dst, block``: blocks are named by the lower end of one of their edges in a spanning forest, by its
    preorder number where ids are no whole numbers. Small components are searched in their bundles.

    Tree edges are named by their lower end. An edge off the tree joins the tree
    edges of its two ends if neither is above the other; a tree edge joins its parent's when its subtree
    reaches out of the parent's subtree. Every edge is in the block of its end with the larger number.
    """
    g = g.written()
    packed = of_graph(g)
    if packed is None:
        return _numbered_blocks(g)
    kind = dict(g.edges.dtypes)["src"]
    small = unpacked(packed[0], _blocks_in, "src long, dst long, block long")
    whole = small if packed[1] is None else small.union(_numbered_blocks(packed[1], named=True).select("src", "dst", F.col("block").cast("long")))
    return whole.select(*[F.col(c).cast(kind).alias(c) for c in ("src", "dst")], "block")


def _numbered_blocks(g: Graph, named: bool = False) -> DataFrame:
    at = _low_high(g)
    up = at.select(F.col("id").alias("parent"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"), F.col("parent").alias("p_parent"))
    reach = at.join(up, "parent").where("p_parent IS NOT NULL AND (low < p_pre OR high >= p_pre + p_size)")
    links = reach.select(F.col("p_pre").alias("src"), F.col("pre").alias("dst"))
    ends = g.edges.select("src", "dst").join(at.select(F.col("id").alias("src"), F.col("pre").alias("a"), F.col("size").alias("na")), "src")
    ends = materialize(ends.join(at.select(F.col("id").alias("dst"), F.col("pre").alias("b"), F.col("size").alias("nb")), "dst"))
    off = ends.where("a + na <= b OR b + nb <= a").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    names = at.where("parent IS NOT NULL").select(F.col("pre").alias("id"))
    block = materialize(connected_components(Graph(names, links.union(off).distinct())))
    found = ends.withColumn("id", F.greatest("a", "b")).join(block, "id").select("src", "dst", F.col("component").alias("block"))
    if named:
        found = found.join(at.select(F.col("pre").alias("block"), "id"), "block").select("src", "dst", F.col("id").alias("block"))
    return found


#: What a row of ``_cuts_in`` says: a bridge, a cut vertex, an edge of the reduced graph, and an edge or a vertex along one of these.
BRIDGE, CUT, LINK, ALONG, BETWEEN = range(5)


def _cuts_in(x):
    """In a chunk of edges: ``kind, a, b, s, t``, what is surely a bridge or cut vertex, and a smaller graph for the rest.

    Blocks and the vertices that they share make a forest. Its ends without a vertex that other chunks have are taken off, whatever is
    elsewhere: a vertex that some hang on is a cut vertex, and those of one edge are bridges. A block that stays
    becomes a ring of the vertices that it shares with others, or an edge between two, which leaves all else as connected as before.
    Of such edges in a row one is made, ``s, t``: what lies along it cuts if and only if no other way leads from s to t.
    """
    ids = np.unique(np.concatenate([x["src"], x["dst"]]))
    a, b = ends_in(ids, x)
    n, m = len(ids), len(a)
    outside = np.zeros(n, bool)
    if x.get("open") is not None:
        outside[np.searchsorted(ids, x["open"])] = True
    outside = outside.tolist()
    block = blocks_of(a, b, n)
    size = np.bincount(block, minlength=n)
    pairs = np.unique(np.concatenate([block * n + a, block * n + b]))
    at, of = (pairs % n).tolist(), (pairs // n).tolist()
    members, homes = [[] for _ in range(n)], [[] for _ in range(n)]
    for v, k in zip(at, of, strict=True):
        members[k].append(v)
        homes[v].append(k)
    left_v, left_b = [len(h) for h in homes], [len(p) for p in members]
    gone_v, gone_b, hung = [False] * n, [not p for p in members], [False] * n
    # a vertex v is asked as v, a block k as n + k
    asked = [v for v in range(n) if not outside[v] and left_v[v] <= 1]
    while asked:
        v = asked.pop()
        if v < n:
            if not gone_v[v]:
                gone_v[v] = True
                for k in homes[v]:
                    if not gone_b[k]:
                        left_b[k] -= 1
                        if left_b[k] <= 1:
                            asked.append(n + k)
        elif not gone_b[v - n]:
            gone_b[v - n] = True
            for w in members[v - n]:
                if not gone_v[w]:
                    hung[w] = True
                    left_v[w] -= 1
                    if left_v[w] <= 1 and not outside[w]:
                        asked.append(w)
    rows = [(CUT, v, v, v, v) for v in range(n) if hung[v] and (outside[v] or len(homes[v]) > 1)]
    own = {}
    for e in np.flatnonzero(size[block] == 1).tolist():
        k = int(block[e])
        if gone_b[k]:
            rows.append((BRIDGE, int(a[e]), int(b[e]), 0, 0))
        else:
            own[k] = e
    ports = {k: [w for w in members[k] if not gone_v[w]] for k in range(n) if not gone_b[k]}
    kept = [[] for _ in range(n)]
    for k, p in ports.items():
        for w in p:
            kept[w].append(k)
    inner = [not outside[v] and not gone_v[v] and len(kept[v]) == 2 and all(len(ports[k]) == 2 for k in kept[v]) for v in range(n)]
    done = set()
    for k, p in ports.items():
        if len(p) > 2:
            rows += [(LINK, 0, 0, min(v, w), max(v, w)) for v, w in zip(p, p[1:] + p[:1], strict=True)]
            continue
        if k in done or all(inner[w] for w in p):
            continue
        start, to = p if not inner[p[0]] else p[::-1]
        along, between, here = [k], [], k
        while inner[to]:
            between.append(to)
            here = kept[to][0] if kept[to][1] == here else kept[to][1]
            along.append(here)
            to = ports[here][0] if ports[here][1] == to else ports[here][1]
        done.update(along)
        s, t = min(start, to), max(start, to)
        rows.append((LINK, 0, 0, s, t))
        rows += [(ALONG, int(a[own[c]]), int(b[own[c]]), s, t) for c in along if c in own]
        rows += [(BETWEEN, v, v, s, t) for v in between]
    made = np.array(rows, np.int64).reshape(-1, 5)
    return {"kind": made[:, 0]} | {c: ids[made[:, k]] for k, c in enumerate(("a", "b", "s", "t"), 1)}


def _cuts(g: Graph) -> tuple[DataFrame, DataFrame, Graph | None]:
    """The rows of ``_cuts_in`` for all chunks, the links ``s, t`` that no other way goes around, and the graph of all links, None if there are none."""
    rows = materialize(unpacked(in_ranges(g.edges, rows_of(g.edges)), _cuts_in, "kind long, a long, b long, s long, t long"), "cuts")
    links = materialize(rows.where(F.col("kind") == LINK).groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.count(F.lit(1)).alias("n")), "links")
    if links.isEmpty():
        return rows, links.select(F.col("src").alias("s"), F.col("dst").alias("t")), None
    small = Graph.of_distinct(links.select("src", "dst")).written()
    alone = materialize(_passed_by_none(small).join(links.where("n = 1"), ["src", "dst"]).select(F.col("src").alias("s"), F.col("dst").alias("t")), "alone")
    return rows, alone, small


def bridges(g: Graph) -> DataFrame:
    """Edges whose removal adds a component. Of whole numbers, what a chunk of edges shows by itself is found there, so little is left of graphs whose
    edges lie near each other; elsewhere and for the rest they are tree edges that no other edge passes over."""
    g = g.written()
    kind = dict(g.edges.dtypes)["src"]
    if kind not in WHOLE:
        return _passed_by_none(g)
    rows, alone, _ = _cuts(g)
    along = rows.where(F.col("kind") == ALONG).join(alone, ["s", "t"], "left_semi")
    found = rows.where(F.col("kind") == BRIDGE).select("a", "b").union(along.select("a", "b"))
    return canonical(found.select(F.col("a").cast(kind).alias("src"), F.col("b").cast(kind).alias("dst")))


def _passed_by_none(g: Graph) -> DataFrame:
    alone = _low_high(g).where("parent IS NOT NULL AND low >= pre AND high < pre + size")
    return canonical(alone.select(F.col("parent").alias("src"), F.col("id").alias("dst")))


def articulation_points(g: Graph) -> DataFrame:
    """Vertices of two blocks or more: their removal adds a component."""
    kind = dict(g.edges.dtypes)["src"]
    if kind not in WHOLE:
        return _shared_by_blocks(_numbered_blocks(g.written()))
    rows, alone, small = _cuts(g.written())
    sure = rows.where(F.col("kind") == CUT).select("a")
    between = rows.where(F.col("kind") == BETWEEN).join(alone, ["s", "t"], "left_semi").select("a")
    found = sure.union(between)
    if small is not None:
        found = found.union(_shared_by_blocks(_numbered_blocks(small)))
    return found.select(F.col("a").cast(kind).alias("id")).distinct()


def _shared_by_blocks(block: DataFrame) -> DataFrame:
    at = block.select(F.col("src").alias("id"), "block").union(block.select("dst", "block")).distinct()
    return at.groupBy("id").count().where("count > 1").select("id")


def test_separators(g: Graph, sets: DataFrame) -> DataFrame:
    """``set_id, components, separates`` for sets ``set_id, id``: what is left when
    a set is taken out. Nothing left also counts as separated, with 0 components."""
    ids = sets.select("set_id").distinct()
    kept = g.vertices.join(F.broadcast(ids) if ids.count() <= 1000 else ids).join(sets.select("set_id", "id"), ["set_id", "id"], "left_anti")
    kept = materialize(kept.select("set_id", "id"))
    a, b = kept.withColumnRenamed("id", "src"), kept.withColumnRenamed("id", "dst")
    edges = g.edges.select("src", "dst").join(a, "src").join(b, ["set_id", "dst"])
    keyed = edges.select(F.struct("set_id", "src").alias("src"), F.struct("set_id", F.col("dst").alias("src")).alias("dst"))
    labels = star_labels(keyed)
    named = kept.withColumn("id", F.struct("set_id", F.col("id").alias("src"))).join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("c"))
    counted = named.groupBy("set_id").agg(F.countDistinct("c").alias("components"))
    return ids.join(counted, "set_id", "left").select(
        "set_id", F.coalesce("components", F.lit(0)).alias("components"), (F.coalesce("components", F.lit(0)) != 1).alias("separates")
    )


def separators(g: Graph, max_size: int, max_sets: int = 100_000) -> DataFrame:
    """``members``, sorted: all sets of up to ``max_size`` vertices that separate the graph, minimal or not."""
    ids = g.vertices.select(F.col("id").alias("last"))
    found, grown = [], ids.select(F.array("last").alias("members"), "last")
    for size in range(1, max_size + 1):
        found.append(grown.select("members"))
        if size < max_size:
            more = ids.withColumnRenamed("last", "next")
            grown = grown.join(more, F.col("last") < F.col("next")).select(F.concat("members", F.array("next")).alias("members"), F.col("next").alias("last"))
    sets = materialize(reduce(DataFrame.union, found))
    n = sets.count()
    if n > max_sets:
        raise ValueError(f"{n} sets are more than max_sets")
    keyed = sets.withColumn("set_id", F.concat_ws(",", F.col("members").cast("array<string>")))
    tested = test_separators(g, keyed.select("set_id", F.explode("members").alias("id")))
    return keyed.join(tested.where("separates"), "set_id").select("members")


def as_tree(g: Graph, root=None) -> DataFrame | None:
    """``id, parent, depth`` from the root (the smallest id unless given); None if the graph is no tree."""
    n, m = g.vertex_count(), g.edge_count()
    if n == 0 or m != n - 1 or component_count(g) != 1:
        return None
    start = g.vertices.agg(F.min("id").alias("id")) if root is None else g.vertices.where(F.col("id") == F.lit(root))
    return reachable_from(g, start).select("id", "parent", F.col("hops").alias("depth"))


def parents_in_tree(g: Graph, root) -> DataFrame | None:
    """``id, parent`` of all vertices of a tree but the root; None if the graph is no tree.

    In each round all leaves go, each below its only neighbour, so a bushy tree's rounds shrink fast.
    """
    left, n = materialize(g.edges.select("src", "dst")), g.vertex_count()
    m, done = left.count(), []
    if n == 0 or m != n - 1:
        return None
    while m:
        arcs = left.union(left.select("dst", "src")).toDF("id", "parent")
        alone = dealt(arcs, 2 * m, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
        leaves = materialize(alone.where((F.col("n") == 1) & (F.col("id") != F.lit(root))).select("id", "parent"))
        gone = canonical(leaves.select(F.col("id").alias("src"), F.col("parent").alias("dst")))
        old, left = left, materialize(left.join(gone, ["src", "dst"], "left_anti"))
        forget(old)
        before, m = m, left.count()
        if m == before:
            return None
        done.append(leaves)
    return reduce(DataFrame.union, done) if done else g.vertices.select("id", F.col("id").alias("parent")).limit(0)


def tree_to_dot(tree: DataFrame, label, name: str = "tree", settings: tuple[str, ...] = ()) -> DataFrame:
    """One text column ``line``: a digraph of ``id, parent``, each line by itself; ``label`` is a Column.

    ``settings`` are lines of the format's own that go first.
    """
    spark = tree.sparkSession
    head = spark.createDataFrame([(0, 0, f"digraph {name} {{")] + [(0, i, f"  {x};") for i, x in enumerate(settings, 1)], "part int, at long, line string")
    tail = spark.createDataFrame([(2, 0, "}")], head.schema)
    nodes = tree.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.format_string('  "%s" [label="%s"];', F.col("id").cast("string"), label.cast("string")).alias("line"))
    arrows = tree.where("parent IS NOT NULL").select(F.lit(1).alias("part"), F.lit(1).cast("long").alias("at"), F.format_string('  "%s" -> "%s";', F.col("parent").cast("string"), F.col("id").cast("string")).alias("line"))
    return head.union(nodes).union(arrows).union(tail).orderBy("part", "at", "line").select("line")
