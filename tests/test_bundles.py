"""Small components worked on whole in bundles: the same results as without, and no rounds of tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise.operators import bundles, chordal, coloring, connectivity, rotation
from arcwise.operators.graph import Graph
from arcwise.storage import materialize
from tests.test_scale import _written


@pytest.fixture
def sizes(monkeypatch):
    def put(most):
        monkeypatch.setattr(bundles, "MOST", most)
        monkeypatch.setattr(bundles, "SIZE", 60)

    return put


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_bundles_hold_each_row_once_and_components_whole(spark, sizes):
    sizes(12)
    rng, rows = random.Random(4), []
    for c in range(40):
        vs = [1000 * c + 7 * k for k in range(rng.choice([1, 2, 3, 5, 9, 30]))]
        rows += [(vs[k], vs[rng.randrange(k)], k) for k in range(1, len(vs))] or [(vs[0], vs[0], 0)]
    for laid in (sorted(rows), rng.sample(rows, len(rows))):
        small, rest = bundles.bundled(spark.createDataFrame(laid, "a long, b long, z long"), "a", "b", "z")
        out = bundles.unpacked(small, lambda x: {"chunk": x["a"] * 0 + x["chunk"], "a": x["a"], "b": x["b"], "z": x["z"]}, "chunk long, a long, b long, z long").collect()
        assert sorted([tuple(r)[1:] for r in out] + _rows(rest)) == sorted(rows)
        assert {r["a"] // 1000 for r in rest.collect()} == {c for c in range(40) if sum(r[0] // 1000 == c for r in rows) > 12}
        assert len({(r["chunk"], r["a"] // 1000) for r in out}) == len({r["a"] // 1000 for r in out})


def test_chordal_steps_are_the_same_in_bundles(spark, sizes):
    """F1, F5, F6, F8, F11, F16."""
    rng, pairs = random.Random(1), set()
    for c in range(8):
        n = rng.randrange(1, 9)
        pairs |= {tuple(sorted(20 * c + v for v in rng.sample(range(n + 1), 2))) for _ in range(n + 2)}
    found = []
    for most in (300, 5):
        sizes(most)
        g = Graph.from_edges(spark.createDataFrame(sorted(pairs), "src long, dst long"), vertices=spark.range(0, 180, 3)).written()
        order = materialize(chordal.low_degree_order(g))
        full = chordal.chordal_completion(g, order).written()
        placed = materialize(chordal.perfect_elimination_order(full))
        bags, tree = (materialize(t) for t in chordal.chordal_tree_decomposition(full, order))
        assert chordal.is_elimination_order(full, placed) and not chordal.is_chordal(g)
        assert chordal.check_decomposition(full, bags, tree).first()[:] == (0, 0, 0, True)
        found.append([_rows(t) for t in (full.edges, placed, bags, tree, coloring.greedy_coloring(g), coloring.chordal_coloring(full, order))])
        if most == 300:
            seen = _written(spark, lambda full=full: chordal.perfect_elimination_order(full))
            assert len(seen) <= 6
    assert found[0] == found[1]


def test_a_vertex_in_two_parts_of_a_tree_is_counted(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    bags = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 0)], "bag_id long, vertex long")
    tree = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert chordal.check_decomposition(g, bags, tree).first()[:] == (0, 0, 1, True)
    assert chordal.check_decomposition(g, bags, tree.limit(1)).first()[:] == (0, 0, 1, False)


def test_faces_and_merged_blocks_are_the_same_in_bundles(spark, sizes):
    """F2, F10, F14."""
    rng, rows, blocks, found = random.Random(1), [], [], []
    for c in range(12):
        n, near = rng.randrange(2, 8), {}
        for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n + 2)}:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        far = lambda v, c=c: 20 * c if v == 0 else 10_000 + 20 * c + v
        for v in near:
            rng.shuffle(near[v])
            rows += [(20 * c + v, k, 20 * c + w) for k, w in enumerate(near[v])]
            blocks += [(2 * c, 20 * c + v, k, 20 * c + w) for k, w in enumerate(near[v])] + [(2 * c + 1, far(v), k, far(w)) for k, w in enumerate(near[v])]
    for most in (300, 9):
        sizes(most)
        one = spark.createDataFrame(rows, "vertex long, pos int, neighbor long")
        two = rotation.merge_blocks(spark.createDataFrame(blocks, "block long, vertex long, pos int, neighbor long"))
        found.append([_rows(t) for t in (rotation.faces(one), rotation.euler_check(one), two, rotation.euler_check(two))])
        if most == 300:
            assert "rings" not in _written(spark, lambda: rotation.faces(one.select("*")).collect())
        assert rotation.faces(spark.createDataFrame(rows[:-1], one.schema)) is None
        with pytest.raises(ValueError):
            rotation.merge_blocks(one.select(F.lit(0).alias("block"), "*").union(one.select(F.lit(1), "*")))
    assert found[0] == found[1]


def test_blocks_are_the_same_in_bundles(spark, sizes):
    """F15."""
    rng, pairs, found = random.Random(7), set(), []
    for c in range(12):
        n = rng.randrange(2, 12)
        pairs |= {tuple(sorted(20 * c + v for v in rng.sample(range(n), 2))) for _ in range(n + 2)}
    for most in (300, 8):
        sizes(most)
        g = Graph.from_edges(spark.createDataFrame(sorted(pairs), "src long, dst long"))
        if most == 300:
            assert "ranks" not in _written(spark, lambda g=g: connectivity.biconnected_components(g).collect())
        blocks = {}
        for r in connectivity.biconnected_components(g).collect():
            blocks.setdefault(r.block, []).append((r.src, r.dst))
        found.append(sorted(map(sorted, blocks.values())))
        assert sorted(sum(blocks.values(), [])) == sorted(pairs)
    assert found[0] == found[1]


def _parts(vertices, edges):
    up = {v: v for v in vertices}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        up[top(a)] = top(b)
    return len({top(v) for v in vertices})


def _brute(edges):
    ends = {v for e in edges for v in e}
    whole = _parts(ends, edges)
    return {e for e in edges if _parts(ends, edges - {e}) > whole}, {v for v in ends if _parts(ends - {v}, {e for e in edges if v not in e}) > whole}


def test_chunks_of_edges_are_reduced_without_losing_a_cut():
    """whatever the chunks are."""
    rng = random.Random(3)
    for trial in range(300):
        n, near = rng.randrange(2, 16), rng.choice([2, 3, 20])
        edges = {tuple(sorted((a, b))) for a in (rng.randrange(n) for _ in range(2 * n)) for b in [min(n - 1, max(0, a + rng.randrange(-near, near + 1)))] if a != b}
        edges |= {(k, k + 1) for k in range(n - 1)} if trial % 3 == 0 else {(0, 1)}
        laid, step = rng.sample(sorted(edges), len(edges)) if trial % 2 else sorted(edges), rng.randrange(1, 9)
        chunks = [laid[k : k + step] for k in range(0, len(laid), step)]
        rows, links = [], {}
        for c in chunks:
            shared = sorted({v for e in c for v in e} & {v for other in chunks if other is not c for e in other for v in e})
            one = connectivity._cuts_in({"src": np.array([e[0] for e in c]), "dst": np.array([e[1] for e in c]), "open": np.array(shared, np.int64)})
            rows += [tuple(int(v) for v in r) for r in zip(*(one[k] for k in ("kind", "a", "b", "s", "t")), strict=True)]
        for r in rows:
            if r[0] == connectivity.LINK:
                links[r[3:]] = links.get(r[3:], 0) + 1
        apart, cuts = _brute(set(links))
        alone = {e for e in apart if links[e] == 1}
        found = {r[1:3] for r in rows if r[0] == connectivity.BRIDGE or (r[0] == connectivity.ALONG and r[3:] in alone)}
        cuts |= {r[1] for r in rows if r[0] == connectivity.CUT or (r[0] == connectivity.BETWEEN and r[3:] in alone)}
        assert ({tuple(sorted(e)) for e in found}, cuts) == _brute(edges)


def test_cuts_of_a_graph_in_many_chunks(spark, monkeypatch):
    """F3, F4."""
    monkeypatch.setattr(bundles, "SIZE", 8)
    rng = random.Random(7)
    edges = {(k, k + 1) for k in range(50) if k % 11} | {tuple(sorted(rng.sample(range(c, c + 6), 2))) for c in range(0, 45, 4) for _ in range(2)} | {(2, 30)}
    g = Graph.from_edges(spark.createDataFrame(sorted(edges), "src long, dst long"))
    lines, cuts = _brute(edges)
    assert {tuple(r) for r in connectivity.bridges(g).collect()} == lines
    assert _rows(connectivity.articulation_points(g)) == sorted((v,) for v in cuts)
