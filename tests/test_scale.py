"""Steps whose work has to follow the input: results against plain counting, and what they write."""

import itertools
import random

from arcwise.operators import components, isomorphism, layout, rotation
from arcwise.operators.graph import Graph
from arcwise.plans.graphs import nation_trade
from arcwise.plans.queries import QUERIES
from arcwise.sources import generators


def _crossing(p, q, r, s):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0


def test_crossings_come_once_without_a_shuffle_of_them(spark):
    rng = random.Random(5)
    for reach, block, cells in ((1.0, 7, None), (0.1, 3000, None), (0.3, 5, 8)):
        at, edges = {}, []
        for k in range(60):
            x, y = rng.random(), rng.random()
            at[2 * k], at[2 * k + 1] = (x, y), (x + reach * (rng.random() - 0.5), y + reach * (rng.random() - 0.5))
            edges.append((2 * k, 2 * k + 1))
        edges += [(0, 2), (1, 5)]
        g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
        places = spark.createDataFrame([(k, *v) for k, v in at.items()], "id long, x double, y double")
        found = layout.edge_crossings(g, places, cells=cells, block=block)
        want = [(*a, *b) for a, b in itertools.combinations(sorted(edges), 2) if not set(a) & set(b) and _crossing(at[a[0]], at[a[1]], at[b[0]], at[b[1]])]
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [e" not in plan and "Aggregate [src_a" not in plan


def _written(spark, f):
    """The labels of the tables that ``f`` writes."""
    import arcwise.storage as storage

    seen, real = [], storage.new_path
    storage.new_path = lambda s, label="table": (seen.append(label), real(s, label))[1]
    try:
        f()
    finally:
        storage.new_path = real
    return seen


def test_components_take_one_round_around_a_hub(spark):
    star = spark.range(1, 200).selectExpr("id AS src", "0L AS dst")
    seen = _written(spark, lambda: components.star_labels(star).collect())
    assert len(seen) <= 4
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + (7 * k) % 31, 200 + (7 * k + 7) % 31) for k in range(30)]
    up = {v: v for e in pairs for v in e}
    for _ in pairs:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    want = {v: c for v, c in up.items() if any(v in e for e in pairs if e[0] != e[1])}
    found = components.star_labels(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r["id"]: r["component"] for r in found} == want and len(found) == len(want)


def test_rings_of_all_lengths_are_placed_without_labels(spark):
    rows, want, base = [], set(), 0
    for n in range(1, 20):
        order = [base + (3 * k) % n if n % 3 else base + k for k in range(n)]
        rows += [(order[k], order[(k + 1) % n]) for k in range(n)]
        least = order.index(min(order))
        want |= {(v, min(order), (k - least) % n, n) for k, v in enumerate(order)}
        base += n
    following = spark.createDataFrame(rows, "id long, next long")
    seen = _written(spark, lambda: rotation._ring_positions(following).collect())
    assert {tuple(r) for r in rotation._ring_positions(following).collect()} == want
    assert set(seen) == {"rings"} and len(seen) <= 7


def test_random_edges_are_drawn_in_place(spark):
    g = generators.random_graph_p(spark, 300, 0.1, seed=2, block=500)
    rows = [tuple(r) for r in g.edges.collect()]
    assert len(rows) == len(set(rows)) and all(0 <= a < b < 300 for a, b in rows)
    assert abs(len(rows) - 4485) < 400 and {v for e in rows for v in e} == set(range(300))
    assert sorted(rows) == sorted(tuple(r) for r in generators.random_graph_p(spark, 300, 0.1, seed=2, block=500).edges.collect())
    assert "Exchange" not in g.edges._jdf.queryExecution().executedPlan().toString()
    assert generators.random_graph_p(spark, 20, 1.0).edges.count() == 190 and generators.random_graph_p(spark, 20, 0.0).edges.count() == 0
    assert generators.random_graph_p(spark, 2_000, 1e-5, seed=4).edges.where("src >= dst OR src < 0 OR dst >= 2000").count() == 0


def test_hubs_of_fixed_rims_are_placed_without_rounds(spark):
    edges = [(0, 1), (0, 2), (0, 3), (4, 1), (4, 5), (5, 2)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    rim = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 0.0, 3.0)], "id long, x double, y double")
    at = {r["id"]: (round(r["x"], 3), round(r["y"], 3)) for r in layout.tutte_layout(g, rim, tol=1e-4, unroll=3).collect()}
    assert at == {0: (1, 1), 1: (0, 0), 2: (3, 0), 3: (0, 3), 4: (1, 0), 5: (2, 0)}
    hub = g.induced(spark.range(4))
    assert len(_written(spark, lambda: layout.tutte_layout(hub, rim).collect())) <= 3
    alone = Graph(g.vertices.union(spark.range(9, 10)), g.edges)
    assert layout.tutte_layout(alone, rim) is None


def test_trade_joins_the_lines_once(spark):
    sf = "/root/testdata/sf0.001"
    plan = nation_trade(spark, sf).edges._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_fingerprint_rounds_write_nothing_and_large_graphs_have_the_same(spark):
    rng = random.Random(9)
    rows, near = [], {}
    for g in range(12):
        pairs = {tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.randrange(4, 14))}
        for copy, name in ((2 * g, lambda v: v), (2 * g + 1, lambda v: 8 - v)):
            rows += [(copy, name(a), name(b)) for a, b in pairs]
            near[copy] = {v: [y for a, b in pairs for x, y in ((name(a), name(b)), (name(b), name(a))) if x == v] for v in range(9)}
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long")
    vertices = spark.createDataFrame([(g, v) for g in near for v in range(9)], "graph_id long, id long")
    classes = {}
    for g, at in near.items():
        label = {v: len(at[v]) for v in at}
        for _ in range(3):
            label = {v: hash((label[v], tuple(sorted(label[w] for w in at[v])))) for v in at}
        classes[g] = tuple(sorted(label.values()))
    for whole in (100_000, 8, 0):
        found = {r["graph_id"]: r["fingerprint"] for r in isomorphism.graph_fingerprints(vertices, edges, whole=whole).collect()}
        assert found.keys() == classes.keys()
        assert all((found[a] == found[b]) == (classes[a] == classes[b]) for a in found for b in found)
    few, many = ([_written(spark, lambda n=n: isomorphism.graph_fingerprints(vertices, edges, n).collect())] for n in (1, 5))
    assert few == many


def test_steps_of_many_rows_are_dealt_into_more_parts(spark):
    pairs = {tuple(sorted(random.Random(k).sample(range(40), 2))) for k in range(120)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    ids = spark.createDataFrame([(v,) for v in range(0, 40, 3)], "id long")
    g = Graph.of_distinct(edges, rows=2_000_000)
    assert sorted(map(tuple, g.edges_at(ids).collect())) == sorted(p for p in pairs if p[0] % 3 == 0 or p[1] % 3 == 0)
    want = {v: sum(v in p for p in pairs) for p in pairs for v in p}
    assert {r["id"]: r["degree"] for r in g.degrees().collect()} == want
    for found in (g.edges_at(ids), g.degrees(), g.remove_vertices(ids).edges):
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    real, generators.dealt = generators.dealt, lambda df, rows, *keys: df.repartition(7, *keys)
    try:
        members = spark.createDataFrame([(k % 10, k % 3) for k in range(30)], "m long, g long")
        found = generators.edges_from_comembership(members, "m", "g")
        assert found.count() == 45
    finally:
        generators.dealt = real


def test_written_computes_edges_once(spark):
    """Vertices that are the ends of the edges are read from the written edges (F9, F11)."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    pairs = spark.range(40).selectExpr("id AS src", "id + 1 AS dst").mapInPandas(counted, "src long, dst long")
    g = Graph.of_distinct(pairs, 40).written()
    assert read.value == 40
    assert g.vertex_count() == 41 and g.edge_count() == 40 and g.rows == 40


def test_all_pairs_of_any_number_of_vertices(spark, tmp_path):
    """Pairs are made in blocks, each once, and the query has no bound (F9)."""
    for n in (0, 1, 4, 25):
        rows = [tuple(r) for r in generators.complete_graph(spark.range(n), None, block=4).edges.collect()]
        assert sorted(rows) == list(itertools.combinations(range(n), 2))
    spark.range(10_001).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = QUERIES["complete_supplier_graph"](spark, str(tmp_path))
    assert found.selectExpr("count(*)", "sum(dst - src)").first()[:] == (50_005_000, sum(d * (10_001 - d) for d in range(10_001)))
