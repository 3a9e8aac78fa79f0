"""Trees, matchings and tours over points against plain versions over all pairs."""

import math

import numpy as np
import pytest

from arcwise.operators import points
from tests.test_fixtures import PLACES


def plain_tree(rows):
    edges = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), a[0], b[0]) for a in rows for b in rows if a[0] < b[0])
    root = {r[0]: r[0] for r in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    total, n = 0.0, 0
    for d, a, b in edges:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            total, n = total + d, n + 1
    return total, n, find


def plain_matching(rows):
    used, out = set(), set()
    for d, a, b in sorted((math.hypot(a[1] - b[1], a[2] - b[2]), a[0], b[0]) for a in rows for b in rows if a[0] < b[0]):
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out


def some_points(kind):
    r = np.random.default_rng(6)
    if kind == "even":
        xy = r.random((200, 2)) * 1000
    elif kind == "clusters":  # dense places far apart, an outlier, and a line
        xy = np.concatenate([r.random((50, 2)), r.random((50, 2)) * 0.1 + [500, 7], [[-1e4, 3]], np.stack([np.arange(40) * 2.0, np.zeros(40)], 1)])
    else:  # a lattice has equal lengths everywhere, and places with several points
        xy = np.array([(i, j) for i in range(9) for j in range(9)] + [(3, 3)] * 5 + [(0, 8)] * 2, float)
    return [(k, float(x), float(y)) for k, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("kind", ["even", "clusters", "lattice"])
def test_tree_and_matching(spark, kind):
    rows = some_points(kind)
    df = spark.createDataFrame(rows, "id long, x double, y double")
    tree = points.spanning_tree_of_points(df).collect()
    total, n, _ = plain_tree(rows)
    at = {r[0]: r[1:] for r in rows}
    assert len(tree) == n == len(rows) - 1
    assert len({(e.src, e.dst) for e in tree}) == n
    assert all(math.isclose(e.cost, math.dist(at[e.src], at[e.dst]), abs_tol=1e-9) for e in tree)
    assert math.isclose(sum(e.cost for e in tree), total, rel_tol=1e-9)
    # linked: a walk from the first point reaches all
    near = {}
    for e in tree:
        near.setdefault(e.src, []).append(e.dst)
        near.setdefault(e.dst, []).append(e.src)
    seen, todo = {0}, [0]
    while todo:
        for v in near[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    assert len(seen) == len(rows)
    if kind != "lattice":
        got = {(min(r.src, r.dst), max(r.src, r.dst)) for r in points.greedy_matching_of_points(df).collect()}
        assert got == plain_matching(rows)


def test_known_places(spark):
    x = list(map(float, PLACES.split()))
    rows = [(k, x[2 * k], x[2 * k + 1]) for k in range(len(x) // 2)]
    at = {r[0]: r[1:] for r in rows}
    tour = [r.id for r in points.tour_of_points(spark.createDataFrame(rows, "id long, x double, y double")).orderBy("step").collect()]
    assert tour[0] == tour[-1] and sorted(tour[1:]) == list(range(52))
    assert sum(math.dist(at[a], at[b]) for a, b in zip(tour, tour[1:])) < 11313.0


def test_few_points(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for n in (0, 1):
        part = df.where(f"id <= {n}")
        assert points.spanning_tree_of_points(part).count() == 0
        assert points.greedy_matching_of_points(part).count() == 0
        assert [r.id for r in points.tour_of_points(part).orderBy("step").collect()] == [1, 1][: 2 * n]
    assert sorted(map(tuple, points.spanning_tree_of_points(df).collect())) == [(1, 2, 0.0), (1, 3, 0.0)]
    assert [r.id for r in points.tour_of_points(df, "double_tree").orderBy("step").collect()][::3] == [1, 1]
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            points.spanning_tree_of_points(spark.createDataFrame([(1, bad, 0.0)], "id long, x double, y double"))
