"""Flows, matchings, colorings, tours, chordal graphs, isomorphism, rotations and layouts on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from arcwise.functions.ranking import list_ranks
from arcwise.operators import chordal, coloring, flow, isomorphism, layout, matching, rotation, tours
from arcwise.operators.graph import Graph
from arcwise.operators.multigraph import MultiGraph
from tests.test_graph import graph, pairs_of, random_edges


def least_cut(n, edges, s, t):
    best = None
    for mask in range(1 << n):
        if mask >> s & 1 and not mask >> t & 1:
            c = sum(w for a, b, w in edges if (mask >> a & 1) != (mask >> b & 1))
            best = c if best is None else min(best, c)
    return best


def test_flow_and_cuts(spark):
    r = random.Random(5)
    n = 7
    edges = [(a, b, r.randint(1, 9)) for a, b in random_edges(n, 0.5, 3)] + [(0, 6, 1)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    arcs = spark.createDataFrame([x for a, b, w in edges for x in ((a, b, w), (b, a, w))], "src long, dst long, capacity long")
    problems = spark.createDataFrame([(t, 0, t) for t in range(1, n)], "problem_id long, source long, sink long")
    sides, value = flow.min_st_cut(arcs, problems)
    assert {r.problem_id: r.value for r in value.collect()} == {t: least_cut(n, edges, 0, t) for t in range(1, n)}
    got = {}
    for x in sides.collect():
        got.setdefault(x.problem_id, {})[x.id] = x.side
    for t, side in got.items():
        assert sum(w for a, b, w in edges if side[a] != side[b]) == least_cut(n, edges, 0, t)
    f = flow.max_flow(arcs, problems.where("problem_id = 6")).collect()
    net = {}
    for x in f:
        net[x.src] = net.get(x.src, 0) + x.flow
    assert all(v == 0 for k, v in net.items() if k not in (0, 6))


def test_cut_tree(spark):
    edges = [(0, 1, 3), (1, 2, 1), (2, 3, 4), (3, 0, 2), (1, 3, 2), (3, 4, 5)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, cost long")).written()
    tree = flow.gomory_hu_tree(g)
    pairs = spark.createDataFrame(list(itertools.combinations(range(5), 2)), "a long, b long")
    got = {(r.a, r.b): r.cost for r in flow.tree_min_cut(tree, pairs).collect()}
    assert got == {(a, b): least_cut(5, edges, a, b) for a, b in itertools.combinations(range(5), 2)}
    _, cost = flow.global_min_cut(g)
    assert cost == min(got.values())
    parts = Graph.from_edges(spark.createDataFrame([(0, 1, 3), (2, 3, 4)], "src long, dst long, cost long")).written()
    assert flow.global_min_cut(parts)[1] == 0


def test_matchings(spark):
    edges = [(a, b, float((a * 7 + b * 3) % 11)) for a, b in random_edges(16, 0.2, 8)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double")).written()
    used, want = set(), set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if w > 0 and a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert pairs_of(matching.greedy_weight_matching(g)) == want
    row = matching.check_matching(g, matching.maximal_matching(g, "weight"), "weight").first()
    assert (row["missing"], row["shared"]) == (0, 0)


def test_bipartite(spark):
    r = random.Random(9)
    for seed in range(2):
        edges = [(a, b) for a in range(7) for b in range(7) if r.random() < 0.28]
        mate = {}

        def grow(a, seen):
            for x, b in edges:  # noqa: B023
                if x == a and b not in seen:
                    seen.add(b)
                    if b not in mate or grow(mate[b], seen):  # noqa: B023
                        mate[b] = a  # noqa: B023
                        return True
            return False

        want = sum(grow(a, set()) for a in range(7))
        m = matching.bipartite_max_matching(spark.createDataFrame(edges, "left long, right long")).collect()
        assert len(m) == want == len({x.left for x in m}) == len({x.right for x in m})
    cost = [[r.randint(1, 20) for _ in range(4)] for _ in range(4)]
    rows = [(a, b, cost[a][b]) for a in range(4) for b in range(4)]
    got = matching.bipartite_min_cost_assignment(spark.createDataFrame(rows, "left long, right long, cost long"))
    assert got.agg(F.sum("cost")).first()[0] == min(sum(cost[i][p[i]] for i in range(4)) for p in itertools.permutations(range(4)))


def test_coloring(spark):
    edges = random_edges(14, 0.3, 6)
    g = graph(spark, edges, extra=range(14))
    rank = spark.createDataFrame([(i, i) for i in range(14)], "id long, rank long")
    want = {}
    for v in range(14):
        near = {want[a + b - v] for a, b in edges if v in (a, b) and a + b - v in want}
        want[v] = next(c for c in range(14) if c not in near)
    assert {r.id: r.color for r in coloring.greedy_coloring(g, rank).collect()} == want
    assert coloring.greedy_coloring(g, rank, max_colors=1) is None
    fixed = spark.createDataFrame([(0, 5)], "id long, color int")
    kept = {r.id: r.color for r in coloring.greedy_coloring(g, rank, fixed).collect()}
    assert kept[0] == 5 and all(kept[a] != kept[b] for a, b in edges)


def test_exact_coloring(spark):
    square = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 4)])
    bags, tree = chordal.chordal_tree_decomposition(square)
    nice = chordal.nice_tree(bags, tree)
    assert coloring.chromatic_number(square, nice) == 3
    assert coloring.color_with_tree(square, 2, nice) is None
    row = coloring.check_coloring(square, coloring.color_with_tree(square, 3, nice)).first()
    assert (row["conflicts"], row["missing"]) == (0, 0)


def test_euler(spark):
    two = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 4)]
    mg = MultiGraph.from_edges(spark.createDataFrame([*two, (0, 1), (0, 1)], "src long, dst long"))
    walk = [r.id for r in tours.eulerian_circuit(mg, start=4).orderBy("step").collect()]
    assert walk[0] == walk[-1] == 4
    used = sorted(tuple(sorted(e)) for e in zip(walk, walk[1:], strict=False))
    assert used == sorted(tuple(sorted(e)) for e in [*two, (0, 1), (0, 1)])
    odd = MultiGraph.from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert not tours.eulerian_check(odd)
    with pytest.raises(ValueError):
        tours.eulerian_circuit(odd)


@pytest.mark.parametrize("method", ["double_tree", "greedy_match"])
def test_tour(spark, method):
    r = random.Random(2)
    at = [(r.random(), r.random()) for _ in range(9)]
    cost = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
    g = graph(spark, [(a, b, cost(a, b)) for a, b in itertools.combinations(range(9), 2)], cost=True)
    row = tours.check_tour(g, tours.tsp_tour(g, method=method), cost="cost").first()
    assert row["closed"] and (row["missing"], row["repeated"], row["no_edge"]) == (0, 0, 0)
    best = min(sum(cost(a, b) for a, b in zip((0, *p), (*p, 0), strict=True)) for p in itertools.permutations(range(1, 9)))
    assert best - 1e-9 <= row["cost"] <= 2 * best


def test_chordal(spark):
    square = [(0, 1), (1, 2), (2, 3), (3, 0)]
    assert not chordal.is_chordal(graph(spark, square))
    assert chordal.is_chordal(graph(spark, [*square, (0, 2)]))
    edges = random_edges(12, 0.25, 11)
    g = graph(spark, edges, extra=range(12))
    order = chordal.low_degree_order(g)
    full = chordal.chordal_completion(g, order).written()
    assert chordal.is_elimination_order(full, order) and pairs_of(full.edges) >= set(edges)
    bags, tree = chordal.chordal_tree_decomposition(full)
    assert chordal.check_decomposition(g, bags, tree).first()[:] == (0, 0, 0, True)
    nice = chordal.nice_tree(bags, tree).collect()
    kids = {}
    for x in nice:
        kids.setdefault(x.parent_id, []).append(x.node_id)
    need = {"leaf": 0, "introduce": 1, "forget": 1, "join": 2}
    assert all(len(kids.get(x.node_id, [])) == need[x.op] for x in nice) and len(kids[None]) == 1
    assert len({x.node_id for x in nice}) == len(nice)


def test_isomorphism(spark):
    edges = random_edges(8, 0.4, 4)
    turn = list(range(8))
    random.Random(1).shuffle(turn)
    other = [tuple(sorted((turn[a], turn[b]))) for a, b in edges]
    hexagon, triangles = [(i, (i + 1) % 6) for i in range(6)], [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    named = {1: edges, 2: other, 3: hexagon, 4: triangles, 5: edges[1:]}
    size = {1: 8, 2: 8, 3: 6, 4: 6, 5: 8}
    v = spark.createDataFrame([(k, i) for k, n in size.items() for i in range(n)], "graph_id long, id long")
    e = spark.createDataFrame([(k, min(x), max(x)) for k, es in named.items() for x in es], "graph_id long, src long, dst long")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 1, 5)], "pair_id long, graph_a long, graph_b long")
    found = isomorphism.find_isomorphism(pairs, v, e)
    rows = found.collect()
    assert {r.pair_id for r in rows} == {1}
    to = {r.id_a: r.id_b for r in rows}
    assert {tuple(sorted((to[a], to[b]))) for a, b in edges} == set(other)
    assert isomorphism.check_isomorphism(graph(spark, edges, range(8)), graph(spark, other, range(8)), found.select("id_a", "id_b"))


def test_isomorphism_of_twins_and_regular_graphs(spark):
    """Forty leaves and a clique of twins on a tree, and two graphs of 16 vertices that refining alone cannot tell apart."""
    twins = [(i, 40 + i % 4) for i in range(40)] + [(40, 44), (41, 44), (42, 45), (43, 45), (44, 45)] + [(a, b) for a in range(46, 60) for b in range(a + 1, 60)] + [(45, i) for i in range(46, 60)]
    at = [(i, j) for i in range(4) for j in range(4)]
    rook = [(4 * a + b, 4 * c + d) for a, b in at for c, d in at if (a, b) < (c, d) and (a == c or b == d)]
    steps = {(0, 1), (1, 0), (1, 1), (0, 3), (3, 0), (3, 3)}
    wound = [(4 * a + b, 4 * c + d) for a, b in at for c, d in at if (a, b) < (c, d) and ((c - a) % 4, (d - b) % 4) in steps]
    moved = lambda edges, n, seed: (lambda turn: [tuple(sorted((turn[a], turn[b]))) for a, b in edges])(random.Random(seed).sample(range(n), n))
    named = {1: (60, twins), 2: (60, moved(twins, 60, 1)), 3: (16, rook), 4: (16, wound), 5: (16, moved(wound, 16, 2))}
    v = spark.createDataFrame([(k, i) for k, (n, _) in named.items() for i in range(n)], "graph_id long, id long")
    e = spark.createDataFrame([(k, min(x), max(x)) for k, (_, es) in named.items() for x in es], "graph_id long, src long, dst long")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 4, 5)], "pair_id long, graph_a long, graph_b long")
    maps = {}
    for r in isomorphism.find_isomorphism(pairs, v, e).collect():
        maps.setdefault(r.pair_id, {})[r.id_a] = r.id_b
    assert set(maps) == {1, 3}
    for pair, a, b in ((1, 1, 2), (3, 4, 5)):
        to = maps[pair]
        assert sorted(to) == sorted(to.values()) == list(range(named[a][0]))
        assert {tuple(sorted((to[x], to[y]))) for x, y in named[a][1]} == set(named[b][1])
    assert isomorphism.find_isomorphism(pairs, v.limit(0), e.limit(0)).count() == 0


def test_isomorphism_by_parts(spark):
    """Rings, paths, single vertices and pieces that are neither, many of them equal, in two graphs under other names."""
    paw = [(0, 1), (1, 2), (0, 2), (2, 3)]
    shapes = [(5, [(i, (i + 1) % 5) for i in range(5)])] * 6 + [(3, [(0, 1), (1, 2), (0, 2)])] * 2 + [(1, [])] * 3 + [(2, [(0, 1)])] * 2 + [(4, [(0, 1), (1, 2), (2, 3)])] + [(4, paw)] * 7
    shapes += [(4, [(0, 1), (0, 2), (0, 3)])] * 2

    def laid(seed, all_shapes):
        n = sum(k for k, _ in all_shapes)
        turn, at, edges = random.Random(seed).sample(range(n), n), 0, set()
        for k, es in random.Random(seed).sample(all_shapes, len(all_shapes)):
            edges |= {tuple(sorted((turn[at + a], turn[at + b]))) for a, b in es}
            at += k
        return n, edges

    other = [*shapes[:-1], (4, paw)]
    named = {1: laid(1, shapes), 2: laid(2, shapes), 3: laid(3, other)}
    v = spark.createDataFrame([(k, i) for k, (n, _) in named.items() for i in range(n)], "graph_id long, id long")
    e = spark.createDataFrame([(k, a, b) for k, (_, es) in named.items() for a, b in es], "graph_id long, src long, dst long")
    rows = isomorphism.find_isomorphism(spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1)], "pair_id long, graph_a long, graph_b long"), v, e).collect()
    assert {r.pair_id for r in rows} == {1}
    to = {r.id_a: r.id_b for r in rows}
    assert sorted(to) == sorted(to.values()) == list(range(named[1][0]))
    assert {tuple(sorted((to[a], to[b]))) for a, b in named[1][1]} == named[2][1]


def test_isomorphism_of_long_and_of_many_rings(spark):
    """One ring of 10,000 vertices, and 10,000 rings of five, each under other names."""
    ids = spark.range(10_000).withColumn("graph_id", F.lit(1).cast("long"))
    one = ids.select("graph_id", F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    many = spark.range(50_000).select(F.lit(3).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") - F.col("id") % 5 + (F.col("id") + 1) % 5).alias("dst"))
    moved = lambda df, n, k: df.select((F.col("graph_id") + 1).alias("graph_id"), *[((F.col(c) * k + 11) % n).alias(c) for c in ("src", "dst")])
    e = one.union(moved(one, 10_000, 7)).union(many).union(moved(many, 50_000, 3))
    v = e.select("graph_id", F.col("src").alias("id"))
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 1, 4)], "pair_id long, graph_a long, graph_b long")
    to = isomorphism.find_isomorphism(pairs, v, e)
    maps = {}
    for r in to.collect():
        maps.setdefault(r.pair_id, {})[r.id_a] = r.id_b
    edges = {}
    for r in e.collect():
        edges.setdefault(r.graph_id, set()).add(tuple(sorted((r.src, r.dst))))
    assert set(maps) == {1, 2}
    for pair, a, b in ((1, 1, 2), (2, 3, 4)):
        assert {tuple(sorted((maps[pair][x], maps[pair][y]))) for x, y in edges[a]} == edges[b]


def test_list_ranks(spark):
    """A list of 1,000 rows, one of one row, and a ring, which has no end."""
    lists = spark.createDataFrame([(i * 7 % 1000, (i + 1) * 7 % 1000 if i < 999 else None) for i in range(1000)] + [(2000, None)], "id long, next long")
    found = {r.id: (r.last, r.steps) for r in list_ranks(lists).collect()}
    assert found == {i * 7 % 1000: (999 * 7 % 1000, 999 - i) for i in range(1000)} | {2000: (2000, 0)}
    with pytest.raises(ValueError):
        list_ranks(spark.createDataFrame([(1, 2), (2, 1)], "id long, next long"), max_rounds=3)


# fixed values: the expected orders of a ring
RING = {0: [3, 1], 1: [0, 2], 2: [1, 3], 3: [2, 0]}


def as_rotation(spark, orders):
    return spark.createDataFrame([(v, i, w) for v, ws in orders.items() for i, w in enumerate(ws)], "vertex long, pos int, neighbor long")


def test_rotation(spark):
    ring = as_rotation(spark, RING)
    walks = {}
    for x in rotation.faces(ring).orderBy("step").collect():
        walks.setdefault((x.face_a, x.face_b), []).append(x.vertex)
    assert len(walks) == 2 and all(w[0] == w[-1] and sorted(w[:-1]) == [0, 1, 2, 3] for w in walks.values())
    assert rotation.euler_check(ring).first()["planar"]
    assert rotation.faces(as_rotation(spark, {0: [1], 1: [2], 2: [1]})) is None
    full = rotation.triangulate(ring)
    assert rotation.euler_check(full).first()[1:] == (4, 6, 4, True)
    crossed = as_rotation(spark, {i: [(i + j) % 5 for j in range(1, 5)] for i in range(5)})
    assert not rotation.euler_check(crossed).first()["planar"]
    with pytest.raises(ValueError):
        rotation.merge_blocks(ring.select(F.lit(0).alias("block"), "*").union(ring.select(F.lit(1), "*")))


@pytest.mark.parametrize("method, n", [("least", 9), ("random", 10), ("least", 200)])
def test_triangulated_ring(spark, method, n):
    ring = as_rotation(spark, {i: [(i + 1) % n, (i - 1) % n] for i in range(n)})
    full = rotation.triangulate(ring, method, seed=3)
    row = rotation.euler_check(full).first()
    assert row["planar"] and row["e"] == 3 * n - 6


def test_triangulated_tree(spark):
    """A path with a branch: one face, in which most vertices occur more than once."""
    tree = as_rotation(spark, {0: [1], 1: [0, 2, 4], 2: [1, 3], 3: [2], 4: [1, 5], 5: [4]})
    row = rotation.euler_check(rotation.triangulate(tree)).first()
    assert row["planar"] and row["e"] == 3 * 6 - 6


def test_layout(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)])
    corners = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 0.0, 1.0)], "id long, x double, y double")
    hub = {r.id: (r.x, r.y) for r in layout.tutte_layout(g, corners).collect()}[3]
    assert hub == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))
    assert layout.tutte_layout(graph(spark, [(0, 1), (5, 6)]), corners.where("id = 0")) is None
    r = random.Random(7)
    at = [(r.random(), r.random()) for _ in range(12)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, x double, y double")
    edges = random_edges(12, 0.3, 1)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    want = set()
    for e, f in itertools.combinations(sorted(edges), 2):
        if not set(e) & set(f):
            p, q, s, t = at[e[0]], at[e[1]], at[f[0]], at[f[1]]
            if turn(p, q, s) * turn(p, q, t) < 0 and turn(s, t, p) * turn(s, t, q) < 0:
                want.add((*e, *f))
    assert {tuple(x) for x in layout.edge_crossings(graph(spark, edges), points).collect()} == want
    box = layout.normalize_layout(points, 100, 50, 5.0).collect()
    assert all(5 - 1e-9 <= x.x <= 95 + 1e-9 and 5 - 1e-9 <= x.y <= 45 + 1e-9 for x in box)
    assert layout.normalize_layout(points.withColumn("x", F.lit(1.0)), 100, 50).count() == 0
