"""Graph operators on small fixed and seeded random graphs, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from arcwise.functions.geometry import euclidean, segments_cross, tsplib_geo_distance
from arcwise.operators import connectivity as cn
from arcwise.operators import paths
from arcwise.operators.graph import Graph
from arcwise.operators.multigraph import MultiGraph
from arcwise.sources import generators, text


def graph(spark, pairs, extra=(), cost=False):
    schema = "src long, dst long" + (", cost double" if cost else "")
    ids = spark.createDataFrame([(v,) for v in extra], "id long") if extra else None
    return Graph.from_edges(spark.createDataFrame(pairs, schema), vertices=ids).written()


def pairs_of(df):
    return {tuple(sorted((r.src, r.dst))) for r in df.collect()}


def components(vertices, edges):
    group = {v: v for v in vertices}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    return group


def random_edges(n, p, seed):
    r = random.Random(seed)
    return [e for e in itertools.combinations(range(n), 2) if r.random() < p]


def test_building(spark):
    g = graph(spark, [(2, 1), (1, 2), (3, 2)], extra=[9])
    assert pairs_of(g.edges) == {(1, 2), (2, 3)}
    assert {r.id: r.degree for r in g.degrees().collect()} == {1: 1, 2: 2, 3: 1, 9: 0}
    assert not g.is_complete() and g.equals(graph(spark, [(1, 2), (2, 3)], extra=[9]))
    with pytest.raises(ValueError):
        graph(spark, [(1, 1)])
    with pytest.raises(ValueError):
        g.relabel(spark.createDataFrame([(1, 5), (2, 5), (3, 6), (9, 7)], "id long, name long"))


def test_sets(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 4)])
    some = spark.createDataFrame([(0,), (1,), (77,)], "id long")
    assert pairs_of(g.cut_set(some)) == {(1, 2)}
    inside, outside, between = g.split(some)
    assert (pairs_of(inside.edges), pairs_of(outside.edges), pairs_of(between)) == ({(0, 1)}, {(3, 4)}, {(1, 2)})
    assert pairs_of(g.union(graph(spark, [(1, 2), (5, 6)])).edges) == {(0, 1), (1, 2), (3, 4), (5, 6)}
    assert g.line_graph().count() == 1


def test_multigraph(spark):
    m = MultiGraph.from_edges(spark.createDataFrame([(1, 2, 2), (2, 1, 3), (2, 3, 1)], "src long, dst long, count long"))
    assert m.edge_count() == 6
    left, gone = m.remove_edges(spark.createDataFrame([(2, 1, 9), (3, 2, 0)], "src long, dst long, count long"))
    assert {(r.src, r.dst): r["count"] for r in left.edges.collect()} == {(2, 3): 1}
    assert [tuple(r) for r in gone.collect()] == [(1, 2, 5)]
    with pytest.raises(ValueError):
        m.relabel(spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, name long"))


def test_components(spark):
    ring = graph(spark, [(i, (i + 1) % 10) for i in range(10)])
    assert cn.component_count(ring) == 1
    alone = Graph(spark.range(10), ring.edges.limit(0))
    assert cn.component_count(alone) == 10
    assert cn.component_count(Graph(spark.range(0), ring.edges.limit(0))) == 1
    edges = random_edges(40, 0.04, 2) + [(i, i + 1) for i in range(100, 130)]
    g = graph(spark, edges, extra=range(40))
    want = components({*range(40), *range(100, 131)}, edges)
    assert {r.id: r.component for r in cn.connected_components(g).collect()} == want


def test_contract(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    groups, small, old = cn.contract(g, spark.createDataFrame([(2, 3)], "src long, dst long"))
    assert {r.id: r.group_id for r in groups.collect()} == {0: 0, 1: 1, 2: 2, 3: 2}
    assert pairs_of(small.edges) == {(0, 1), (0, 2), (1, 2)} and old.count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_and_cut_vertices(spark, seed):
    edges = random_edges(14, 0.14, seed)
    g = graph(spark, edges, extra=range(14))
    count = lambda v, e: len(set(components(v, e).values()))
    whole = count(range(14), edges)
    want = {e for e in edges if count(range(14), [x for x in edges if x != e]) > whole}
    assert pairs_of(cn.bridges(g)) == want
    degree = {v for e in edges for v in e}
    cuts = {v for v in degree if count(set(range(14)) - {v}, [e for e in edges if v not in e]) > whole}
    assert {r.id for r in cn.articulation_points(g).collect()} == cuts


def test_separators_and_trees(spark):
    path = graph(spark, [(0, 1), (1, 2), (2, 3)])
    sets = {tuple(r.members) for r in cn.separators(path, 2).collect()}
    want = {s for k in (1, 2) for s in itertools.combinations(range(4), k) if len(set(components(set(range(4)) - set(s), [e for e in ((0, 1), (1, 2), (2, 3)) if not set(e) & set(s)]).values())) != 1}
    assert sets == want
    tree = {r.id: (r.parent, r.depth) for r in cn.as_tree(path, 1).collect()}
    assert tree == {1: (None, 0), 0: (1, 1), 2: (1, 1), 3: (2, 2)}
    assert cn.as_tree(graph(spark, [(0, 1), (1, 2), (0, 2)])) is None
    assert cn.as_tree(graph(spark, [(0, 1), (1, 2), (0, 2)], extra=[9])) is None  # as many edges as a tree
    lines = [r.line for r in cn.tree_to_dot(cn.as_tree(path), F.col("id")).collect()]
    assert lines[0] == "digraph tree {" and lines[-1] == "}" and '  "1" -> "2";' in lines


SIX = [(1, 2, 7.0), (1, 3, 9.0), (1, 6, 14.0), (2, 3, 10.0), (2, 4, 15.0), (3, 6, 2.0), (3, 4, 11.0), (4, 5, 6.0), (5, 6, 9.0)]


def walk(df):
    return [r.id for r in df.orderBy("step").collect()]


def test_shortest_path(spark):
    g = graph(spark, SIX, cost=True)
    assert walk(paths.shortest_path(g, 1, 5)) == [1, 3, 6, 5]
    assert walk(paths.shortest_path(g, 4, 6)) == [4, 3, 6]
    far = graph(spark, [(0, 1, 1.0), (2, 3, 1.0)], cost=True)
    assert paths.shortest_path(far, 0, 3).count() == 0
    with pytest.raises(ValueError):
        paths.shortest_path(graph(spark, [(0, 1, -1.0)], cost=True), 0, 1)


def test_spanning_forest(spark):
    names = "ABCDEF"
    listed = "AB1 AD4 AE3 BD4 BE2 DE4 CE4 CF5 EF7".split()
    g = graph(spark, [(names.index(x[0]), names.index(x[1]), float(x[2])) for x in listed], cost=True)
    assert paths.minimum_spanning_forest(g).agg(F.sum("cost")).first()[0] == 16
    edges = [(a, b, float(a * b % 5)) for a, b in random_edges(30, 0.07, 4)]
    g = graph(spark, edges, extra=range(30), cost=True)
    tree = [(r.src, r.dst) for r in paths.minimum_spanning_forest(g).collect()]
    want = components(range(30), [e[:2] for e in edges])
    assert components(range(30), tree) == want and len(tree) == 30 - len(set(want.values()))


def test_geometry(spark):
    row = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0)], "a double, b double, c double, d double")
    assert row.select(euclidean("a", "b", "c", "d")).first()[0] == 5.0
    ulysses = spark.createDataFrame([(38.24, 20.42, 39.57, 26.15)], "a double, b double, c double, d double")
    assert ulysses.select(tsplib_geo_distance("a", "b", "c", "d")).first()[0] == pytest.approx(510, abs=1)
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert row.select(segments_cross(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), segments_cross(p(0, 0), p(1, 1), p(2, 2), p(3, 3))).first()[:] == (True, False)


def test_sources(spark, tmp_path):
    assert generators.complete_graph(spark.range(5)).is_complete()
    with pytest.raises(ValueError):
        generators.complete_graph(spark.range(5), max_vertices=4)
    assert generators.random_graph_m(spark, 100, 100, 1).edges.distinct().count() == 100
    with pytest.raises(ValueError):
        generators.random_graph_m(spark, 3, 4)
    assert 247 < generators.random_graph_p(spark, 100, 0.1, 1).edges.count() < 990
    k = generators.random_k_tree(spark, 12, 2, seed=2).edges
    assert k.distinct().count() == k.count() == 3 + 2 * 9
    good = tmp_path / "a.tsp"
    good.write_text("NAME: x\nNODE_COORD_SECTION\n1 2.5 3\n 2  4 5e1\nEOF\n3 x y\n")
    assert [tuple(r)[1:] for r in text.read_tsplib_points(spark, str(good)).collect()] == [("1", 2.5, 3.0), ("2", 4.0, 50.0)]
    for bad in ("1 2 3\n", "NODE_COORD_SECTION\n1 2\nEOF\n", "NODE_COORD_SECTION\n1 a 3\n"):
        (tmp_path / "b.tsp").write_text(bad)
        with pytest.raises(ValueError):
            text.read_tsplib_points(spark, str(tmp_path / "b.tsp"))
    marks = spark.createDataFrame([('<path class="ab-cd"><path class="ef">',), (None,)], "svg string")
    g = text.edges_from_markup(marks, "svg", 'class="([a-z]{2})-([a-z]{2})"', 'class="([a-z]{2})"')
    assert pairs_of(g.edges) == {("ab", "cd")} and g.vertex_count() == 3
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (1, "y"), (None, "y")], "m long, g string")
    assert pairs_of(generators.edges_from_comembership(rows, "m", "g")) == {(1, 2), (1, 3)}
