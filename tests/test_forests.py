"""Euler tours, extremes over ranges, bridges and blocks of deep graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from arcwise.operators import connectivity as cn
from arcwise.operators.forests import preorder, range_extremes
from arcwise.operators.graph import Graph
from arcwise.operators.paths import rooted_spanning_forest


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def block_sets(edges):
    """The blocks as sets of edges, by depth-first search."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    num, low, found = {}, {}, []
    for root in near:
        if root in num:
            continue
        num[root] = low[root] = len(num)
        stack, way = [], [(root, None, iter(near[root]))]
        while way:
            v, up, rest = way[-1]
            for w in rest:
                if w not in num:
                    stack.append((v, w))
                    num[w] = low[w] = len(num)
                    way.append((w, v, iter(near[w])))
                    break
                if w != up and num[w] < num[v]:
                    stack.append((v, w))
                    low[v] = min(low[v], num[w])
            else:
                way.pop()
                if way:
                    low[up] = min(low[up], low[v])
                    if low[v] >= num[up]:
                        block = set()
                        while (up, v) not in block:
                            block.add(stack.pop())
                        found.append(frozenset(tuple(sorted(e)) for e in block))
    return set(found)


def found_blocks(g):
    rows = {}
    for r in cn.biconnected_components(g).collect():
        rows.setdefault(r.block, set()).add((r.src, r.dst))
    return {frozenset(x) for x in rows.values()}


def deep_graph(seed, n=1500):
    """Two trees with long branches, some chords near and far, and a triangle apart."""
    rng = random.Random(seed)
    edges = {(v - 1 if rng.random() < 0.9 else rng.randrange(v), v) for v in range(1, n)}
    edges |= {(n + max(0, v - 1 - rng.randrange(3)), n + v) for v in range(1, n // 3)}
    for _ in range(n // 15):
        a = rng.randrange(n)
        edges.add((a, min(n - 1, a + 2 + rng.randrange(6))))
    edges |= {(n // 3, n // 2), (9000, 9001), (9001, 9002), (9000, 9002)}
    return sorted(e for e in edges if e[0] < e[1])


def test_preorder(spark):
    edges = [(0, 1), (0, 5), (1, 2), (1, 3), (7, 8)]
    rows = {r.id: r for r in preorder(table(spark, edges), spark.createDataFrame([(1,), (8,)], "id long")).collect()}
    assert {v: r.parent for v, r in rows.items()} == {0: 1, 1: None, 2: 1, 3: 1, 5: 0, 7: 8, 8: None}
    assert {v: r.size for v, r in rows.items()} == {0: 2, 1: 5, 2: 1, 3: 1, 5: 1, 7: 1, 8: 2}
    assert sorted(r.pre for r in rows.values()) == list(range(7))
    for r in rows.values():  # a subtree is a range
        assert r.parent is None or rows[r.parent].pre < r.pre < r.pre + r.size <= rows[r.parent].pre + rows[r.parent].size
    assert preorder(table(spark, []), spark.createDataFrame([], "id long")).count() == 0


@pytest.mark.parametrize("block", [4, 16])
def test_extremes_of_nested_and_long_ranges(spark, block):
    rng = random.Random(block)
    n = 300
    rows = [(i, rng.choice([1, 2, block, n - i, rng.randrange(1, n - i + 1)]) if i + block < n else n - i, rng.randrange(1000), rng.randrange(1000)) for i in range(n)]
    found = {r.pre: (r.low, r.high) for r in range_extremes(spark.createDataFrame(rows, "pre long, size long, lo long, hi long"), block).collect()}
    assert found == {i: (min(r[2] for r in rows[i : i + s]), max(r[3] for r in rows[i : i + s])) for i, s, _, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_blocks(spark, seed):
    edges = deep_graph(seed)
    g = Graph.from_edges(table(spark, edges), vertices=spark.createDataFrame([(99999,)], "id long"))
    want = block_sets(edges)
    assert found_blocks(g) == want
    assert {(r.src, r.dst) for r in cn.bridges(g).collect()} == {e for b in want if len(b) == 1 for e in b}


def test_names_as_text_and_no_edges(spark):
    g = Graph.from_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string"))
    assert {(r.src, r.dst) for r in cn.bridges(g).collect()} == {("c", "d")}
    assert {r.id for r in cn.articulation_points(g).collect()} == {"c"}
    none = Graph.from_edges(table(spark, []), vertices=spark.createDataFrame([(1,)], "id long"))
    assert cn.bridges(none).count() == 0 and cn.biconnected_components(none).count() == 0


def test_long_path_ring_and_hub(spark):
    """A path and a ring of 100,000 vertices and a hub of 50,000 leaves, in rounds that follow the logarithm."""
    n = 100_000
    i = spark.range(n)
    path = i.where(f"id < {n - 1}").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = i.select((F.col("id") + n).alias("src"), ((F.col("id") + 1) % n + n).alias("dst"))
    hub = spark.range(1, 50_001).select(F.lit(2 * n).alias("src"), (F.col("id") + 2 * n).alias("dst"))
    g = Graph.from_edges(path.union(ring).union(hub)).written()
    forest, roots = rooted_spanning_forest(g)
    assert forest.count() == n - 1 + n - 1 + 50_000 and roots.count() == 3
    found = cn.bridges(g)
    assert found.count() == n - 1 + 50_000 and found.where(f"src >= {n} AND src < {2 * n}").count() == 0
