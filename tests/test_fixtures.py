"""Known answers: two sets of cities, an assignment, and small arithmetic on flows, sets and multigraphs."""

import pytest
from pyspark.sql import functions as F

from arcwise.functions.geometry import euclidean, tsplib_geo_distance
from arcwise.operators import connectivity, flow, matching, tours
from arcwise.operators.graph import Graph
from arcwise.operators.multigraph import MultiGraph

# fixed values: coordinates of 52 places and of 14 cities, and bounds of half as much again as the shortest tours
PLACES = (
    "565 575 25 185 345 750 945 685 845 655 880 660 25 230 525 1000 580 1175 650 1130 1605 620 1220 580 1465 200 1530 5 845 680 725 370 145 665 "
    "415 635 510 875 560 365 300 465 520 585 480 415 835 625 975 580 1215 245 1320 315 1250 400 660 180 410 250 420 555 575 665 1150 1160 700 580 "
    "685 595 685 610 770 610 795 645 720 635 760 650 475 960 95 260 875 920 700 500 555 815 830 485 1170 65 830 610 605 625 595 360 1340 725 1740 245"
)
CITIES = (
    "16.47 96.10 16.47 94.44 20.09 92.54 22.39 93.37 25.23 97.24 22.00 96.05 20.47 97.02 17.20 96.29 16.30 97.38 14.05 98.12 16.53 97.38 21.52 95.59 19.41 97.13 20.09 94.55"
)
# fixed values: costs of an assignment and its best pairs
COSTS = [
    [0.63703113, 0.05463863, 0.7068842, 0.881898, 0.51384588], [0.4628616, 0.89583315, 0.96715435, 0.64414505, 0.6300843],
    [0.6044282, 0.41535184, 0.66711726, 0.42664525, 0.01200919], [0.09214885, 0.18397983, 0.26484529, 0.52215792, 0.6478958],
    [0.42073377, 0.8417317, 0.94740205, 0.07050757, 0.13856445],
]
BEST = {0: 1, 1: 0, 2: 4, 3: 2, 4: 3}


@pytest.mark.parametrize("places, distance, bound", [(PLACES, euclidean, 11313.0), (CITIES, tsplib_geo_distance, 4984.5)])
def test_tour_of_known_places(spark, places, distance, bound):
    x = list(map(float, places.split()))
    rows = [(k, x[2 * k], x[2 * k + 1]) for k in range(len(x) // 2)]
    pairs = [(i, j, a, b, c, d) for i, a, b in rows for j, c, d in rows if i < j]
    edges = spark.createDataFrame(pairs, "src long, dst long, a double, b double, c double, d double")
    g = Graph(spark.createDataFrame([(i,) for i, _, _ in rows], "id long"), edges.select("src", "dst", distance("a", "b", "c", "d").alias("cost")))
    row = tours.check_tour(g, tours.tsp_tour(g.written(), method="greedy_match"), cost="cost").first()
    assert row["closed"] and row["missing"] == row["repeated"] == row["no_edge"] == 0
    assert row["cost"] < bound


def test_known_assignment(spark):
    rows = [(i, j, c) for i, costs in enumerate(COSTS) for j, c in enumerate(costs)]
    found = matching.bipartite_min_cost_assignment(spark.createDataFrame(rows, "left long, right long, cost double")).collect()
    assert {r.left: r.right for r in found} == BEST


def test_small_arithmetic(spark):
    f = flow.add_flow(spark.createDataFrame([], "src long, dst long, flow long"), spark.createDataFrame([(1, 2, 5), (2, 3, 4)], "src long, dst long, flow long"))
    asked = spark.createDataFrame([(2, 1), (2, 3), (1, 3)], "src long, dst long")
    assert {(r.src, r.dst): r.flow for r in flow.flow_between(f, asked).collect()} == {(2, 1): -5, (2, 3): 4, (1, 3): 0}
    arcs = spark.createDataFrame([(1, 2, 5), (2, 1, 5), (2, 3, 6), (3, 2, 6)], "src long, dst long, capacity long")
    ends = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert ends(flow.residual_arcs(arcs, f)) == {(2, 1), (2, 3), (3, 2)}
    assert ends(flow.residual_arcs(arcs, f, both_ways=True)) == {(2, 3)}
    values = spark.createDataFrame([(k,) for k in range(6)], "id long")
    merged = connectivity.disjoint_sets(values, spark.createDataFrame([(0, 3), (3, 5), (2, 2)], "src long, dst long"), include_single=False)
    assert {r.id: r.set_id for r in merged.collect()} == {0: 0, 3: 0, 5: 0}
    g = Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    assert {(r.src, r.dst): r["count"] for r in MultiGraph.from_graph(g).edges.collect()} == {(1, 2): 1, (2, 3): 1}
    assert g.induced(F.col("id") > 1).edge_count() == 1
