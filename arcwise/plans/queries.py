"""The registered graph queries and their SQL.

Queries whose result SQL cannot compute return counts of broken rules, which must be 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwise.functions.geometry import euclidean, orientation, segments_cross, tsplib_geo_distance
from arcwise.operators import chordal, coloring, connectivity, flow, isomorphism, layout, matching, paths, rotation, tours
from arcwise.operators.graph import Graph
from arcwise.operators.multigraph import MultiGraph
from arcwise.plans.graphs import CA, CP, LC, NT, OR, OW, PS, PTS, RT, US, copurchase, copurchase_all, labelled_chains, nation_trade, numbered_lines, order_necklace, order_rings, order_wheels, part_supplier, region_trade, table, user_sequence, vector_points
from arcwise.sources import generators, text
from arcwise.storage import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def one_row(spark: SparkSession, **values) -> DataFrame:
    """A row of whole numbers."""
    return spark.createDataFrame([tuple(int(v) for v in values.values())], ", ".join(f"{k} long" for k in values))


def rules(*names: str) -> str:
    return "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in names)


def large_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size >= 25").select(F.col("p_partkey").alias("id"))


LP = "lp AS (SELECT p_partkey AS id FROM part WHERE p_size >= 25)"


# -- sources and generators


@query(f"WITH {CP} SELECT src, dst, cost FROM cp")
def copurchase_edges(spark, sf):
    return copurchase(spark, sf).edges.select("src", "dst", "cost")


@query("SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def complete_supplier_graph(spark, sf):
    return generators.complete_graph(table(spark, sf, "supplier").select("s_suppkey"), max_vertices=None).edges


@query("SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey")
def comembership_edges(spark, sf):
    return generators.edges_from_comembership(table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey")


@query(f"WITH {PTS} SELECT CAST(id AS VARCHAR) AS id, x, y FROM pts")
def tsplib_points(spark, sf):
    """All points by way of files: each task writes one of some thousand points with its header."""
    line = F.concat_ws(" ", "id", "x", "y")
    points = vector_points(spark, sf).select(F.floor(F.col("id") / 4096).alias("file"), F.struct(F.lit(2).alias("part"), "id").alias("at"), line.alias("value"))
    head = points.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.struct(F.lit(k).alias("part"), F.lit(0).cast("long").alias("id")).alias("at"), F.lit(x).alias("value")) for k, x in enumerate(("NAME : vectors", "NODE_COORD_SECTION"))])).alias("h"))
    rows = points.union(head.select("file", "h.at", "h.value"))
    path = new_path(spark, "tsp")
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)
    return text.read_tsplib_points(spark, path).select("id", "x", "y")


_LINK = r'href="(/[^"]+)">([^<]+)</a>'


@query(rf"""WITH l AS (SELECT unnest(regexp_extract_all(html, '{_LINK}', 1)) AS a, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS b FROM pages)
SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM l""")
def markup_edges(spark, sf):
    """The target and the words of every link."""
    return text.edges_from_markup(table(spark, sf, "pages"), "html", _LINK, r'href="(/[^"]+)"').edges


@query(rules("loops", "outside") .replace("SELECT", "SELECT CAST(1 AS BIGINT) AS plausible,"))
def random_edges_by_chance(spark, sf):
    n = table(spark, sf, "supplier").count() + 90
    m, expected = F.count(F.lit(1)), 0.1 * n * (n - 1) / 2
    plausible = (m > expected / 2) & (m < expected * 2)
    return generators.random_graph_p(spark, n, 0.1, seed=3).edges.agg(plausible.cast("long").alias("plausible"), F.count_if(F.expr("src >= dst")).alias("loops"), F.count_if(F.expr(f"src < 0 OR dst >= {n}")).alias("outside"))


@query("SELECT count(*) AS edges, count(*) AS pairs FROM supplier")
def random_edges_by_number(spark, sf):
    n = table(spark, sf, "supplier").count()
    e = generators.random_graph_m(spark, n + 5, n, seed=4).edges
    return e.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src", "dst").alias("pairs"))


@query("SELECT CAST(6 + 3 * (count(*) + 6 - 3 - 1) AS BIGINT) AS edges, CAST(1 AS BIGINT) AS chordal FROM nation")
def random_k_tree(spark, sf):
    n = table(spark, sf, "nation").count() + 6
    g = generators.random_k_tree(spark, n, 3, seed=5).written()
    return one_row(spark, edges=g.edges.distinct().count(), chordal=chordal.is_chordal(g))


# -- graphs and sets


@query(f"WITH {CP} SELECT src AS id, list_sort(list(dst)) AS neighbors FROM cpa GROUP BY src")
def adjacency_lists(spark, sf):
    return copurchase(spark, sf).adjacency


@query(f"WITH {CP} SELECT (SELECT count(*) FROM cp) AS edges, (SELECT count(*) FROM cpv) AS vertices, CAST(0 AS BIGINT) AS complete")
def graph_counts(spark, sf):
    g = copurchase(spark, sf).written()
    return one_row(spark, edges=g.edge_count(), vertices=g.vertex_count(), complete=g.is_complete())


@query(f"WITH {CP} SELECT src AS id, count(*) AS degree FROM cpa GROUP BY src")
def vertex_degrees(spark, sf):
    return copurchase(spark, sf).degrees()


@query(f"WITH {CP} SELECT src AS id FROM cpa GROUP BY src HAVING count(*) % 2 = 1")
def odd_vertices(spark, sf):
    return copurchase(spark, sf).odd_vertices()


@query(f"WITH {CP}, {LP} SELECT src AS id, dst AS neighbor FROM cpa WHERE src IN (SELECT id FROM lp)")
def neighbors_of_large_parts(spark, sf):
    return copurchase(spark, sf).neighbors(large_parts(spark, sf))


@query(f"WITH {CP}, {LP} SELECT src, dst, cost FROM cp WHERE src IN (SELECT id FROM lp) OR dst IN (SELECT id FROM lp)")
def edges_at_large_parts(spark, sf):
    return copurchase(spark, sf).edges_at(large_parts(spark, sf))


@query(f"WITH {CP}, q AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey AND a.l_linenumber = 1) SELECT q.src, q.dst, c.src IS NOT NULL AS present FROM q LEFT JOIN cp c ON c.src = least(q.src, q.dst) AND c.dst = greatest(q.src, q.dst)")
def edge_membership(spark, sf):
    rows = table(spark, sf, "lineitem")
    first = rows.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    asked = first.join(rows.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("src <> dst").select("src", "dst").distinct()
    return copurchase(spark, sf).contains_edges(asked)


@query(f"WITH {CP} SELECT p_partkey AS id, p_partkey IN (SELECT id FROM cpv) AS present FROM part")
def vertex_membership(spark, sf):
    return copurchase(spark, sf).contains_vertices(table(spark, sf, "part").select("p_partkey"))


def _order_ends(spark, sf) -> Graph:
    """The parts of each order's first and last line."""
    row = F.struct("l_linenumber", "l_partkey")
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(row)["l_partkey"].alias("src"), F.max(row)["l_partkey"].alias("dst"))
    return Graph.from_edges(ends.where("src <> dst").select("src", "dst"))


SO = "so AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT min(l_linenumber * 1000000000000 + l_partkey) % 1000000000000 AS a, max(l_linenumber * 1000000000000 + l_partkey) % 1000000000000 AS b FROM lineitem GROUP BY l_orderkey) WHERE a <> b)"


@query(f"WITH {CP}, {SO} SELECT src, dst FROM cp UNION SELECT src, dst FROM so")
def graph_union(spark, sf):
    a = copurchase(spark, sf)
    return Graph(a.vertices, a.edges.select("src", "dst")).union(_order_ends(spark, sf)).edges


@query(f"WITH {CP}, {LP} SELECT src, dst, cost FROM cp WHERE src NOT IN (SELECT id FROM lp) AND dst NOT IN (SELECT id FROM lp)")
def without_large_parts(spark, sf):
    return copurchase(spark, sf).remove_vertices(large_parts(spark, sf)).edges


@query(f"WITH {CP}, {SO} SELECT src, dst FROM cp EXCEPT SELECT src, dst FROM so")
def without_edges(spark, sf):
    return copurchase(spark, sf).remove_edges(_order_ends(spark, sf).edges).edges.select("src", "dst")


@query(f"WITH {CP}, {LP} SELECT src, dst, cost FROM cp WHERE src IN (SELECT id FROM lp) AND dst IN (SELECT id FROM lp)")
def induced_large_parts(spark, sf):
    return copurchase(spark, sf).induced(large_parts(spark, sf)).edges


@query(f"WITH {CP} SELECT least('part ' || src, 'part ' || dst) AS src, greatest('part ' || src, 'part ' || dst) AS dst, cost FROM cp")
def relabelled(spark, sf):
    g = copurchase(spark, sf).written()
    return g.relabel(g.vertices.select("id", F.concat(F.lit("part "), "id").alias("name"))).edges


@query("SELECT CAST(1 AS BIGINT) AS same, CAST(0 AS BIGINT) AS fewer")
def graph_equality(spark, sf):
    g = copurchase(spark, sf).written()
    back = Graph.from_edges(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return one_row(spark, same=g.equals(back), fewer=g.equals(g.remove_vertices(g.vertices.limit(1))))


@query(f"""WITH {CP}, inc AS (SELECT src AS v, src, dst FROM cp UNION ALL SELECT dst, src, dst FROM cp)
SELECT a.src AS src_a, a.dst AS dst_a, b.src AS src_b, b.dst AS dst_b FROM inc a JOIN inc b ON a.v = b.v AND (a.src < b.src OR (a.src = b.src AND a.dst < b.dst))""")
def line_graph(spark, sf):
    return copurchase(spark, sf).line_graph()


@query(f"WITH {CP}, {LP} SELECT src, dst, cost FROM cp WHERE (src IN (SELECT id FROM lp)) <> (dst IN (SELECT id FROM lp))")
def cut_of_large_parts(spark, sf):
    return copurchase(spark, sf).cut_set(large_parts(spark, sf))


@query(f"""WITH {CP}, {LP}, f AS (SELECT (src IN (SELECT id FROM lp))::INT + (dst IN (SELECT id FROM lp))::INT AS k FROM cp)
SELECT CASE k WHEN 2 THEN 'inside' WHEN 0 THEN 'outside' ELSE 'between' END AS part, count(*) AS edges FROM f GROUP BY 1""")
def split_by_large_parts(spark, sf):
    inside, outside, between = copurchase(spark, sf).split(large_parts(spark, sf))
    tagged = [e.select(F.lit(n).alias("part")) for n, e in (("inside", inside.edges), ("outside", outside.edges), ("between", between))]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("part").agg(F.count(F.lit(1)).alias("edges"))


# -- multigraphs


@query(f"WITH {NT} SELECT * FROM nt")
def trade_multigraph(spark, sf):
    return nation_trade(spark, sf).edges


@query(f'WITH {NT}, e AS (SELECT src AS id, "count" FROM nt UNION ALL SELECT dst, "count" FROM nt) SELECT n_nationkey AS id, CAST(coalesce(sum("count"), 0) AS BIGINT) AS degree FROM nation LEFT JOIN e ON id = n_nationkey GROUP BY 1')
def multigraph_degrees(spark, sf):
    return nation_trade(spark, sf).degrees()


@query(f'WITH {NT}, p AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) SELECT p.src, p.dst, coalesce(nt."count", 0) AS "count" FROM p LEFT JOIN nt ON nt.src = least(p.src, p.dst) AND nt.dst = greatest(p.src, p.dst)')
def multigraph_lookup(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    asked = n.toDF("src", "r").join(n.toDF("dst", "r"), "r").where("src <> dst")
    return nation_trade(spark, sf).contains(asked)


@query(f'WITH {NT}, r AS (SELECT * FROM nation WHERE n_regionkey = 1) SELECT src, dst, "count" FROM nt WHERE src IN (SELECT n_nationkey FROM r) OR dst IN (SELECT n_nationkey FROM r)')
def multigraph_edges_at(spark, sf):
    return nation_trade(spark, sf).edges_at(table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey"))


@query(f'WITH {NT}, {US} SELECT src, dst, CAST(sum("count") AS BIGINT) AS "count" FROM (SELECT * FROM nt UNION ALL SELECT * FROM us) GROUP BY 1, 2')
def multigraph_sum(spark, sf):
    a = nation_trade(spark, sf)
    wide = MultiGraph(a.vertices.select(F.col("id").cast("long")), a.edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), "count"))
    return wide.add_edges(user_sequence(spark, sf).edges).edges


@query(f'WITH {NT} SELECT src, dst, "count" - least("count", 5) AS "count", least("count", 5) AS removed FROM nt WHERE "count" > least("count", 5)')
def multigraph_removal(spark, sf):
    g = nation_trade(spark, sf)
    left, removed = g.remove_edges(g.edges.select("dst", "src", F.lit(5).alias("count")))
    return left.edges.join(removed, ["src", "dst"])


@query(f'WITH {NT} SELECT src, dst, "count" FROM nt WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND dst NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)')
def multigraph_without_region(spark, sf):
    return nation_trade(spark, sf).remove_vertices(table(spark, sf, "nation").where("n_regionkey = 2").select("n_nationkey")).edges


@query(f'WITH {NT} SELECT least(a.n_name, b.n_name) AS src, greatest(a.n_name, b.n_name) AS dst, "count" FROM nt JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst')
def multigraph_names(spark, sf):
    return nation_trade(spark, sf).relabel(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).edges


# -- connectivity

REACH = "reach(id, component) AS (SELECT id, id FROM cpv UNION SELECT a.dst, r.component FROM reach r JOIN cpa a ON a.src = r.id WHERE r.component < a.dst), lab AS (SELECT id, min(component) AS component FROM reach GROUP BY id)"


@query(f"WITH RECURSIVE {CP}, {REACH} SELECT id, component FROM lab")
def connected_components(spark, sf):
    return connectivity.connected_components(copurchase(spark, sf).written())


@query(f"WITH RECURSIVE {CP}, {REACH} SELECT component, count(*) AS size FROM lab GROUP BY component")
def component_sizes(spark, sf):
    return connectivity.connected_components(copurchase(spark, sf).written()).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


# over all rows of lineitem; no SQL where recursion over so many edges is too slow


@query()
def whole_components(spark, sf):
    return connectivity.connected_components(copurchase_all(spark, sf).written())


@query()
def whole_component_sizes(spark, sf):
    return connectivity.connected_components(part_supplier(spark, sf).written()).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(f"WITH {CA} SELECT src AS id, count(*) AS degree FROM caa GROUP BY src")
def whole_degrees(spark, sf):
    return copurchase_all(spark, sf).degrees()


@query(f"WITH {PS} SELECT src, dst, weight FROM ps")
def whole_part_suppliers(spark, sf):
    return part_supplier(spark, sf).edges


@query(f"WITH RECURSIVE {CP}, {REACH} SELECT count(DISTINCT component) AS components FROM lab")
def component_count(spark, sf):
    return one_row(spark, components=connectivity.component_count(copurchase(spark, sf).written()))


def _first_vertex(g: Graph) -> DataFrame:
    return g.vertices.agg(F.min("id").alias("id"))



@query(f"""WITH RECURSIVE {CP}, b(id, hops, seen) AS (SELECT id, 0, id FROM (SELECT min(id) AS id FROM cpv) UNION ALL
 SELECT DISTINCT a.dst, b.hops + 1, a.dst FROM b JOIN cpa a ON a.src = b.id WHERE a.dst NOT IN (SELECT seen FROM recurring.b)),
h AS (SELECT id, min(hops) AS hops FROM b GROUP BY id)
SELECT h.id, h.hops, min(p.id) AS parent FROM h LEFT JOIN cpa a ON a.src = h.id LEFT JOIN h p ON p.id = a.dst AND p.hops = h.hops - 1 GROUP BY h.id, h.hops""")
def reachable(spark, sf):
    g = copurchase(spark, sf).written()
    return connectivity.reachable_from(g, _first_vertex(g))


@query(f"""WITH RECURSIVE {SO}, v AS (SELECT p_partkey AS id FROM part), a AS (SELECT src, dst FROM so UNION ALL SELECT dst, src FROM so),
reach(id, c) AS (SELECT id, id FROM v UNION SELECT a.dst, r.c FROM reach r JOIN a ON a.src = r.id WHERE r.c < a.dst)
SELECT id, min(c) AS set_id FROM reach GROUP BY id""")
def merged_sets(spark, sf):
    return connectivity.disjoint_sets(table(spark, sf, "part").select("p_partkey"), _order_ends(spark, sf).edges)


def _cheap(g: Graph) -> DataFrame:
    return g.edges.where("cost % 5 = 0").select("src", "dst")


@query(f"""WITH RECURSIVE {CP}, k AS (SELECT src, dst FROM cpa WHERE cost % 5 = 0),
reach(id, c) AS (SELECT id, id FROM cpv UNION SELECT k.dst, r.c FROM reach r JOIN k ON k.src = r.id WHERE r.c < k.dst), g AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst, cp.src AS old_src, cp.dst AS old_dst FROM cp JOIN g a ON a.id = cp.src JOIN g b ON b.id = cp.dst WHERE a.c <> b.c""")
def contracted(spark, sf):
    g = copurchase(spark, sf).written()
    return connectivity.contract(g, _cheap(g))[2]


@query(f"WITH {OR} SELECT src, dst FROM orr WHERE n = 2")
def bridge_edges(spark, sf):
    """Bridges of the rings of lines: the edges of orders of two lines."""
    return connectivity.bridges(order_rings(spark, sf))


@query(f"WITH {OR}, b AS (SELECT o, count(*) AS edges FROM orr GROUP BY 1) SELECT edges, count(*) AS blocks FROM b GROUP BY edges")
def ring_blocks(spark, sf):
    """Blocks of the rings of lines by size: each order of two lines or more is one."""
    block = connectivity.biconnected_components(order_rings(spark, sf)).groupBy("block").agg(F.count(F.lit(1)).alias("edges"))
    return block.groupBy("edges").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"""WITH {OR} SELECT a.place AS src, b.place AS dst FROM orl a JOIN orl b ON b.place = a.place + 1 JOIN orn ON orn.o = a.o WHERE a.o <> b.o OR orn.n = 2""")
def necklace_bridges(spark, sf):
    """Bridges of all lines on one string, which is as long as there are orders: the links, and orders of two lines."""
    return connectivity.bridges(order_necklace(spark, sf))


@query(f"""WITH {OR}, far AS (SELECT max(place) AS last_place FROM orl), own AS (SELECT place, lo, n, last_place FROM orl JOIN orn USING (o) CROSS JOIN far)
SELECT place AS id FROM own WHERE CAST(place = lo AND place > 0 AS INT) + CAST(place = lo + n - 1 AND place < last_place AS INT) + CAST(n > 1 AS INT) >= 2""")
def necklace_cuts(spark, sf):
    """Articulation points of all lines on one string: lines that meet two of their order's block and its links."""
    return connectivity.articulation_points(order_necklace(spark, sf))


@query(rules("missed", "wrong"))
def cut_vertices(spark, sf):
    """Articulation points of the nation and region trade against taking each vertex out."""
    g = _sparse_trade(spark, sf).written()
    found = materialize(connectivity.articulation_points(g).select(F.col("id").cast("long")))
    whole = connectivity.component_count(g)
    tested = connectivity.test_separators(g, g.vertices.select(F.col("id").alias("set_id"), "id"))
    alone = g.degrees().where("degree > 0").select(F.col("id").alias("set_id"))
    true = tested.join(alone, "set_id").where(F.col("components") > whole).select(F.col("set_id").cast("long").alias("id"))
    return one_row(spark, missed=true.exceptAll(found).count(), wrong=found.exceptAll(true).count())


def _sparse_trade(spark, sf) -> Graph:
    """Each nation with the two nations it trades most with."""
    e = nation_trade(spark, sf).edges
    both = e.union(e.select("dst", "src", "count"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "dst"))).where("r <= 2")
    return Graph.from_edges(top.select("src", "dst").distinct(), vertices=table(spark, sf, "nation").select("n_nationkey"))


@query(rules("shared", "uncovered"))
def blocks(spark, sf):
    """Blocks hold every edge once and share one vertex at most."""
    g = copurchase(spark, sf).written()
    b = materialize(connectivity.biconnected_components(g))
    at = b.select(F.col("src").alias("v"), "block").union(b.select("dst", "block")).distinct()
    shared = at.toDF("v", "x").join(at.toDF("v", "y"), "v").where("x < y").groupBy("x", "y").count().where("count > 1").count()
    return one_row(spark, shared=shared, uncovered=g.edges.select("src", "dst").exceptAll(b.select("src", "dst")).count())


SPT = f"""{NT}, arcs AS (SELECT src, dst, "count" AS n FROM nt UNION ALL SELECT dst, src, "count" FROM nt),
top AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM arcs), st AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM top WHERE r <= 2),
sta AS (SELECT src, dst FROM st UNION ALL SELECT dst, src FROM st)"""


@query(f"""WITH RECURSIVE {SPT}, kept AS (SELECT s.n_nationkey AS s, v.n_nationkey AS id FROM nation s JOIN nation v ON s.n_nationkey <> v.n_nationkey),
reach(s, id, c) AS (SELECT s, id, id FROM kept UNION SELECT r.s, a.dst, r.c FROM reach r JOIN sta a ON a.src = r.id WHERE a.dst <> r.s AND r.c < a.dst),
lab AS (SELECT s, id, min(c) AS c FROM reach GROUP BY 1, 2)
SELECT s AS set_id, count(DISTINCT c) AS components, count(DISTINCT c) <> 1 AS separates FROM lab GROUP BY 1""")
def tested_separators(spark, sf):
    g = _sparse_trade(spark, sf).written()
    return connectivity.test_separators(g, g.vertices.select(F.col("id").alias("set_id"), "id"))


@query(f"""WITH RECURSIVE {SPT}, sets AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION ALL SELECT x.n_nationkey, y.n_nationkey FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey),
reach(a, b, id, c) AS (SELECT a, b, n_nationkey, n_nationkey FROM sets JOIN nation ON n_nationkey <> a AND n_nationkey <> b
 UNION SELECT r.a, r.b, e.dst, r.c FROM reach r JOIN sta e ON e.src = r.id WHERE e.dst <> r.a AND e.dst <> r.b AND r.c < e.dst),
lab AS (SELECT a, b, id, min(c) AS c FROM reach GROUP BY 1, 2, 3)
SELECT CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS members FROM lab GROUP BY a, b HAVING count(DISTINCT c) > 1""")
def nation_separators(spark, sf):
    """Sets of one or two nations that part the sparse trade graph, or leave it in parts."""
    found = connectivity.separators(_sparse_trade(spark, sf).written(), 2)
    return found.select(F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


@query(f"""WITH RECURSIVE {RT}, rta AS (SELECT src, dst FROM rt UNION ALL SELECT dst, src FROM rt), v AS (SELECT DISTINCT src AS id FROM rta),
sets AS (SELECT id AS a, id AS b FROM v UNION ALL SELECT x.id, y.id FROM v x JOIN v y ON x.id < y.id),
reach(a, b, id, c) AS (SELECT a, b, id, id FROM sets JOIN v ON id <> a AND id <> b
 UNION SELECT r.a, r.b, e.dst, r.c FROM reach r JOIN rta e ON e.src = r.id WHERE e.dst <> r.a AND e.dst <> r.b AND r.c < e.dst),
lab AS (SELECT a, b, id, min(c) AS c FROM reach GROUP BY 1, 2, 3)
SELECT CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS members FROM lab GROUP BY a, b HAVING count(DISTINCT c) > 1""")
def region_separators(spark, sf):
    """Sets of one or two regions that part the trade: none while all regions trade with each other."""
    found = connectivity.separators(region_trade(spark, sf).written(), 2)
    return found.select(F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


def _spanning_tree(spark, sf) -> Graph:
    """The cheapest tree over the nations, by lines traded."""
    mg = nation_trade(spark, sf)
    g = Graph(mg.vertices, mg.edges.withColumnRenamed("count", "cost"))
    return Graph(g.vertices, materialize(paths.minimum_spanning_forest(g)))


@query("SELECT count(*) AS vertices, CAST(1 AS BIGINT) AS roots, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS cycle FROM nation")
def rooted_tree(spark, sf):
    t = _spanning_tree(spark, sf)
    rooted = materialize(connectivity.as_tree(t))
    up = rooted.alias("c").join(rooted.alias("p"), F.col("c.parent") == F.col("p.id"))
    mg = nation_trade(spark, sf)
    return one_row(
        spark, vertices=rooted.count(), roots=rooted.where("parent IS NULL").count(),
        broken=up.where("c.depth <> p.depth + 1").count(), cycle=connectivity.as_tree(Graph(mg.vertices, mg.edges)) is not None,
    )


@query("SELECT CAST(2 * count(*) + 3 AS BIGINT) AS lines, count(*) - 1 AS arrows, count(*) AS nodes, CAST(0 AS BIGINT) AS strange FROM nation")
def dot_lines(spark, sf):
    rooted = connectivity.as_tree(_spanning_tree(spark, sf)).join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), "id")
    dot = connectivity.tree_to_dot(rooted, F.col("n_name"), settings=("rankdir=LR", "node [shape=box]"))
    known = F.col("line").rlike(r'^(digraph tree \{|  rankdir=LR;|  node \[shape=box\];|  "\d+" \[label="[^"]+"\];|  "\d+" -> "\d+";|\})$')
    return dot.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").contains("->")).alias("arrows"), F.count_if(F.col("line").contains("[label=")).alias("nodes"), F.count_if(~known).alias("strange"))


# -- paths


@query(rules("improvable", "unfounded"))
def shortest_paths(spark, sf):
    """Distances from the first part: no edge improves one, and each comes from its parent's."""
    g = copurchase(spark, sf).written()
    d = materialize(paths.shortest_paths(g, _first_vertex(g)))
    near = g.arcs.join(d.select(F.col("id").alias("src"), F.col("dist").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("dist").alias("b"), "parent"), "dst", "left")
    return near.agg(
        F.count_if(F.coalesce(F.col("a") + F.col("cost") < F.col("b"), F.col("b").isNull())).alias("improvable"),
        (F.max(F.lit(d.where("parent IS NOT NULL").count())) - F.count_if((F.col("parent") == F.col("src")) & (F.col("a") + F.col("cost") == F.col("b")))).alias("unfounded"),
    )


@query(f"""WITH RECURSIVE {RT}, a AS (SELECT src, dst, cost FROM rt UNION ALL SELECT dst, src, cost FROM rt),
w(source, id, dist, n) AS (SELECT src, src, CAST(0 AS BIGINT), 0 FROM a UNION SELECT w.source, a.dst, w.dist + a.cost, w.n + 1 FROM w JOIN a ON a.src = w.id WHERE w.n < 4)
SELECT source, id, min(dist) AS dist FROM w GROUP BY 1, 2""")
def region_distances(spark, sf):
    g = region_trade(spark, sf).written()
    return paths.shortest_paths(g, g.vertices).select("source", "id", "dist")


@query(rules("broken", "too_long"))
def path_between(spark, sf):
    """The path from the first part to the one farthest from it, against the distance."""
    g = copurchase(spark, sf).written()
    d = materialize(paths.shortest_paths(g, _first_vertex(g)))
    far = d.orderBy(F.desc("dist"), "id").first()
    p = materialize(paths.shortest_path(g, far["source"], far["id"]))
    check = tours.check_tour(g, p, cost="cost").first()
    return one_row(spark, broken=check["no_edge"], too_long=check["cost"] != far["dist"])


@query(f"""WITH RECURSIVE {CP}, {REACH}, n AS (SELECT count(*) - count(DISTINCT component) AS edges FROM lab) SELECT edges, CAST(0 AS BIGINT) AS improvable FROM n""")
def spanning_forest(spark, sf):
    """A forest of all components, where no edge off it is cheaper than one on the path it closes (by threshold components)."""
    g = copurchase(spark, sf).written()
    t = materialize(paths.minimum_spanning_forest(g))
    bad = 0
    for q in (0.25, 0.5, 0.75):
        limit = g.edges.approxQuantile("cost", [q], 0.0)[0]
        whole = connectivity.connected_components(Graph(g.vertices, g.edges.where(F.col("cost") <= limit)))
        part = connectivity.connected_components(Graph(g.vertices, t.where(F.col("cost") <= limit)))
        bad += whole.exceptAll(part).count()
    return one_row(spark, edges=t.count(), improvable=bad)


# -- flow and cuts


def _trade_arcs(spark, sf) -> DataFrame:
    e = nation_trade(spark, sf).edges.select("src", "dst", F.col("count").alias("capacity"))
    return materialize(e.union(e.select("dst", "src", "capacity")))


def _problems(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").agg(F.min("n_nationkey").alias("source"), F.max("n_nationkey").alias("sink"))
    return n.select(F.lit(1).alias("problem_id"), "source", "sink")


@query(rules("leaking", "over", "cut_apart"))
def trade_max_flow(spark, sf):
    """Flow between the first and last nation: kept at inner vertices, within capacity, and equal to its cut."""
    arcs, problems = _trade_arcs(spark, sf), _problems(spark, sf)
    f = materialize(flow.max_flow(arcs, problems))
    p = problems.first()
    net = f.groupBy("src").agg(F.sum("flow").alias("net"))
    leaking = net.where((F.col("src") != p["source"]) & (F.col("src") != p["sink"]) & (F.col("net") != 0)).count()
    over = f.join(arcs, ["src", "dst"], "left").where(F.col("flow") > F.coalesce("capacity", F.lit(0))).count()
    sides, value = flow.min_st_cut(arcs, problems)
    side = sides.select("id", "side")
    cut = arcs.join(side.toDF("src", "a"), "src").join(side.toDF("dst", "b"), "dst").where("a = 1 AND b = 0").agg(F.sum("capacity")).first()[0]
    return one_row(spark, leaking=leaking, over=over, cut_apart=not cut == value.first()["value"] == flow.total_flow(f, p["source"]).first()[0])


@query(f'WITH {NT}, f AS (SELECT src, dst, "count" AS flow FROM nt UNION ALL SELECT dst, src, -"count" FROM nt) SELECT src, dst, CAST(CASE WHEN src = 0 AND dst = 1 THEN 7 WHEN src = 1 AND dst = 0 THEN -7 ELSE 2 * flow END AS BIGINT) AS flow FROM f')
def flow_arithmetic(spark, sf):
    """A flow table doubled by adding itself, and one pair set; the pair is among all nations that trade."""
    e = nation_trade(spark, sf).edges.select("src", "dst", F.col("count").alias("flow"))
    f = flow.add_flow(e.limit(0), e)
    pair = spark.createDataFrame([(0, 1, 7)], "src int, dst int, flow long")
    return flow.set_flow(flow.add_flow(f, e), pair.join(e.select("src", "dst"), ["src", "dst"], "left_semi")).select("src", "dst", F.col("flow").cast("long").alias("flow"))


@query(f'WITH {NT} SELECT src, dst FROM nt WHERE "count" > 10 UNION ALL SELECT dst, src FROM nt')
def residual(spark, sf):
    """Room that is left when each pair carries ten lines, or all it has, in one direction."""
    e = nation_trade(spark, sf).edges
    arcs = e.select("src", "dst", F.col("count").alias("capacity"))
    f = flow.add_flow(arcs.select("src", "dst", F.lit(0).cast("long").alias("flow")).limit(0), e.select("src", "dst", F.least("count", F.lit(10)).alias("flow")))
    return flow.residual_arcs(arcs.union(arcs.select("dst", "src", "capacity")), f)


@query(f"""WITH {RT}, v AS (SELECT src AS id FROM rt UNION SELECT dst FROM rt), b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v),
m AS (SELECT unnest(range(1, CAST(pow(2, (SELECT count(*) FROM v)) AS BIGINT) - 1)) AS mask)
SELECT min(c) AS cost FROM (SELECT mask, CAST(sum(cost) AS BIGINT) AS c FROM m, rt JOIN b x ON x.id = rt.src JOIN b y ON y.id = rt.dst
 WHERE (mask >> x.k) & 1 <> (mask >> y.k) & 1 GROUP BY mask)""")
def least_region_cut(spark, sf):
    _, cost = flow.global_min_cut(region_trade(spark, sf).written())
    return one_row(spark, cost=cost)


def _region_tree(spark, sf) -> DataFrame:
    return materialize(flow.gomory_hu_tree(region_trade(spark, sf).written()))


CUTS = f"""{RT}, v AS (SELECT src AS id FROM rt UNION SELECT dst FROM rt), k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v),
m AS (SELECT unnest(range(1, CAST(pow(2, (SELECT count(*) FROM v)) AS BIGINT) - 1)) AS mask),
c AS (SELECT mask, CAST(sum(cost) AS BIGINT) AS c FROM m, rt JOIN k x ON x.id = rt.src JOIN k y ON y.id = rt.dst WHERE (mask >> x.k) & 1 <> (mask >> y.k) & 1 GROUP BY mask)"""


@query(f"""WITH {CUTS} SELECT x.id AS a, y.id AS b, min(c.c) AS cost FROM k x JOIN k y ON x.id < y.id JOIN c ON (c.mask >> x.k) & 1 <> (c.mask >> y.k) & 1 GROUP BY 1, 2""")
def cut_tree_pairs(spark, sf):
    """The least cut of every pair of regions, read off the cut tree."""
    g = region_trade(spark, sf).written()
    pairs = g.vertices.select(F.col("id").alias("a")).join(g.vertices.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    return flow.tree_min_cut(_region_tree(spark, sf), pairs).select("a", "b", "cost")


@query(rules("apart"))
def cut_tree_sides(spark, sf):
    """Each tree edge's cost is that of the split it makes."""
    g, t = region_trade(spark, sf).written(), _region_tree(spark, sf)
    cuts = materialize(flow.tree_cuts(t))
    s, d = cuts.select("child", F.col("id").alias("src"), F.col("side").alias("a")), cuts.select("child", F.col("id").alias("dst"), F.col("side").alias("b"))
    cost = g.edges.join(s, "src").join(d, ["child", "dst"]).where("a <> b").groupBy("child").agg(F.sum("cost").alias("is_cost"))
    return one_row(spark, apart=cuts.select("child", F.col("cost").alias("said")).distinct().join(cost, "child", "left").where("said <> coalesce(is_cost, -1)").count())


# -- matching


@query(rules("missing", "shared", "addable"))
def greedy_matching(spark, sf):
    """Heaviest pairs of parts and suppliers: a matching to which no edge can be added."""
    g = part_supplier(spark, sf).written()
    m = materialize(matching.greedy_weight_matching(g))
    row = matching.check_matching(g, m, "weight").first()
    used = m.select("src").union(m.select("dst"))
    return one_row(spark, missing=row["missing"], shared=row["shared"], addable=g.remove_vertices(used).edge_count())


@query(rules("missing", "shared", "addable"))
def maximal_matching(spark, sf):
    g = order_rings(spark, sf).written()
    m = materialize(matching.maximal_matching(g))
    row = matching.check_matching(g, m).first()
    return one_row(spark, missing=row["missing"], shared=row["shared"], addable=g.remove_vertices(m.select("src").union(m.select("dst"))).edge_count())


@query(f"""WITH {PS}, m AS (SELECT src, min(dst) AS dst FROM ps GROUP BY src) SELECT count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, CAST(0 AS BIGINT) AS missing,
 (SELECT count(*) FROM (SELECT dst FROM m GROUP BY dst HAVING count(*) > 1)) AS shared FROM m JOIN ps USING (src, dst)""")
def matching_check(spark, sf):
    """The check on pairs that are no matching: each part with its first supplier."""
    g = part_supplier(spark, sf)
    return matching.check_matching(g, g.edges.groupBy("src").agg(F.min("dst").alias("dst")), "weight")


@query(rules("shared", "uncovered", "apart"))
def largest_matching(spark, sf):
    """Parts and suppliers: as many pairs as a vertex cover has vertices (built from alternating reach)."""
    e = part_supplier(spark, sf).edges.select(F.col("src").alias("left"), F.col("dst").alias("right"))
    e = materialize(e)
    m = materialize(matching.bipartite_max_matching(e))
    shared = m.count() - min(m.select("left").distinct().count(), m.select("right").distinct().count())
    forth = e.join(m, ["left", "right"], "left_anti").select(F.col("left").alias("src"), F.col("right").alias("dst"))
    arcs = forth.union(m.select(F.col("right").alias("src"), F.col("left").alias("dst")))
    free = e.select("left").distinct().join(m, "left", "left_anti").select(F.col("left").alias("id"))
    near = materialize(connectivity.reachable_from(arcs, free).select("id"))
    cover = e.select(F.col("left").alias("id")).distinct().join(near, "id", "left_anti").union(e.select(F.col("right").alias("id")).distinct().join(near, "id", "left_semi"))
    cover = materialize(cover)
    open_edges = e.join(cover.toDF("left"), "left", "left_anti").join(cover.toDF("right"), "right", "left_anti").count()
    return one_row(spark, shared=shared, uncovered=open_edges, apart=abs(cover.count() - m.count()))


@query(f"""WITH {RT}, r AS (SELECT src AS id FROM rt UNION SELECT dst FROM rt), e AS (SELECT src AS l, dst AS r, cost FROM rt UNION ALL SELECT dst, src, cost FROM rt)
SELECT min(a.cost + b.cost + c.cost + d.cost + f.cost) AS cost FROM e a, e b, e c, e d, e f
WHERE a.l = 0 AND b.l = 1 AND c.l = 2 AND d.l = 3 AND f.l = 4 AND a.r <> b.r AND a.r <> c.r AND a.r <> d.r AND a.r <> f.r AND b.r <> c.r AND b.r <> d.r AND b.r <> f.r AND c.r <> d.r AND c.r <> f.r AND d.r <> f.r""")
def cheapest_assignment(spark, sf):
    """Each region to another one, with the fewest lines in all."""
    e = region_trade(spark, sf).edges
    both = e.select(F.col("src").alias("left"), F.col("dst").alias("right"), "cost").union(e.select("dst", "src", "cost"))
    return matching.bipartite_min_cost_assignment(both).agg(F.sum("cost").alias("cost"))


# -- coloring


@query(rules("conflicts", "missing", "not_least"))
def greedy_coloring(spark, sf):
    """A proper coloring in which every vertex has neighbours of all smaller colors."""
    g = order_rings(spark, sf).written()
    c = materialize(coloring.greedy_coloring(g))
    row = coloring.check_coloring(g, c).first()
    near = g.arcs.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("b < a").groupBy("src", "a").agg(F.countDistinct("b").alias("n"))
    full = near.where("n = a").count()
    return one_row(spark, conflicts=row["conflicts"], missing=row["missing"], not_least=c.where("color > 0").count() - full)


@query(f"WITH {CP} SELECT count(*) FILTER (src % 3 = dst % 3) AS conflicts, CAST(0 AS BIGINT) AS missing, (SELECT count(DISTINCT id % 3) FROM cpv) AS colors FROM cp")
def coloring_check(spark, sf):
    g = copurchase(spark, sf)
    return coloring.check_coloring(g, g.vertices.select("id", (F.col("id") % 3).alias("color")))


def _filled_rings(spark, sf) -> tuple[Graph, DataFrame]:
    g = order_rings(spark, sf).written()
    order = materialize(chordal.low_degree_order(g))
    return chordal.chordal_completion(g, order).written(), order


@query(rules("conflicts", "missing", "above_width"))
def chordal_coloring(spark, sf):
    """As many colors as the largest bag has vertices."""
    g, order = _filled_rings(spark, sf)
    c = materialize(coloring.chordal_coloring(g, order))
    row = coloring.check_coloring(g, c).first()
    bags, _ = chordal.chordal_tree_decomposition(g, order)
    return one_row(spark, conflicts=row["conflicts"], missing=row["missing"], above_width=row["colors"] - 1 - chordal.tree_width(bags))


def _region_nice(spark, sf) -> tuple[Graph, DataFrame]:
    g = region_trade(spark, sf).written()
    bags, tree = chordal.chordal_tree_decomposition(g)
    return g, materialize(chordal.nice_tree(materialize(bags), materialize(tree)))


@query(f"WITH {RT} SELECT count(DISTINCT id) AS colors, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS missing FROM (SELECT src AS id FROM rt UNION SELECT dst FROM rt)")
def exact_coloring(spark, sf):
    """The least number of colors by tables over a nice tree; regions all trade, so each needs its own."""
    g, nice = _region_nice(spark, sf)
    k = coloring.chromatic_number(g, nice)
    row = coloring.check_coloring(g, coloring.color_with_tree(g, k, nice)).first()
    return one_row(spark, colors=k, conflicts=row["conflicts"], missing=row["missing"])


# -- tours


def _even_trade(spark, sf) -> MultiGraph:
    """Every pair that trades, as two edges, so that all degrees are even."""
    mg = nation_trade(spark, sf)
    return MultiGraph(mg.vertices, materialize(mg.edges.select("src", "dst", F.lit(2).cast("long").alias("count"))))


@query("SELECT CAST(1 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS lonely")
def euler_condition(spark, sf):
    mg = _even_trade(spark, sf)
    more = mg.vertices.union(mg.vertices.agg(F.max("id") + 1))
    return one_row(spark, doubled=tours.eulerian_check(mg), lonely=tours.eulerian_check(MultiGraph(more, mg.edges)))


@query(f"WITH {NT} SELECT src, dst, CAST(2 AS BIGINT) AS times FROM nt")
def euler_circuit(spark, sf):
    """How often the circuit over doubled trade edges takes each pair: twice."""
    walk = materialize(tours.eulerian_circuit(_even_trade(spark, sf)))
    nxt = walk.select((F.col("step") - 1).alias("step"), F.col("id").alias("to"))
    return walk.join(nxt, "step").groupBy(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst")).agg(F.count(F.lit(1)).alias("times"))


def _supplier_points(spark, sf) -> Graph:
    """Nations placed by the means of their suppliers' and customers' balances, and all distances."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.avg("s_acctbal").alias("x"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("y"))
    p = materialize(s.join(c, "id"))
    a, b = p.toDF("src", "x1", "y1"), p.toDF("dst", "x2", "y2")
    pairs = a.join(b, F.col("src") < F.col("dst")).select("src", "dst", euclidean("x1", "y1", "x2", "y2").alias("cost"))
    return Graph(p.select("id"), materialize(pairs))


@query("SELECT CAST(1 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS no_edge, CAST(0 AS BIGINT) AS over_bound")
def double_tree_tour(spark, sf):
    """A tour of all nations no longer than twice the spanning tree."""
    g = _supplier_points(spark, sf)
    row = tours.check_tour(g, materialize(tours.tsp_tour(g)), cost="cost").first()
    tree = paths.minimum_spanning_forest(g).agg(F.sum("cost")).first()[0]
    return one_row(spark, closed=row["closed"], missing=row["missing"], repeated=row["repeated"], no_edge=row["no_edge"], over_bound=row["cost"] > 2 * tree + 1e-9)


@query("SELECT CAST(1 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS no_edge")
def matched_tour(spark, sf):
    g = _supplier_points(spark, sf)
    row = tours.check_tour(g, materialize(tours.tsp_tour(g, method="greedy_match")), cost="cost").first()
    return one_row(spark, closed=row["closed"], missing=row["missing"], repeated=row["repeated"], no_edge=row["no_edge"])


@query("SELECT TRUE AS closed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS no_edge, CAST(count(*) AS BIGINT) AS cost, CAST(1 AS BIGINT) AS unused FROM nation")
def tour_check(spark, sf):
    """The nations in order of key, of which the edge of keys 0 and 2 is no part."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    g = generators.complete_graph(n)
    order = n.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).alias("step"), "id")
    tour = order.union(n.agg(F.count(F.lit(1)).cast("int"), F.min("id")))
    need = g.edges.where("src = 0 AND dst = 2")
    return tours.check_tour(g, tour, need).select("closed", "missing", "repeated", "no_edge", "cost", "unused")


# -- chordal graphs


@query("SELECT CAST(1 AS BIGINT) AS filled, CAST(0 AS BIGINT) AS lost")
def completed_order(spark, sf):
    """The order by degree eliminates the completed graph, which keeps all edges."""
    g = order_rings(spark, sf).written()
    order = materialize(chordal.low_degree_order(g))
    done = chordal.chordal_completion(g, order)
    return one_row(spark, filled=chordal.is_elimination_order(done, order), lost=g.edges.select("src", "dst").exceptAll(done.edges).count())


@query(f"""WITH {OR}, a AS (SELECT src, dst FROM orr UNION ALL SELECT dst, src FROM orr), d AS (SELECT id, count(src) AS d FROM orv LEFT JOIN a ON src = id GROUP BY 1), p AS (SELECT id, row_number() OVER (ORDER BY d, id) AS pos FROM d),
l AS (SELECT a.src AS v, a.dst AS u, y.pos FROM a JOIN p x ON x.id = a.src JOIN p y ON y.id = a.dst WHERE x.pos < y.pos), f AS (SELECT v, min_by(u, pos) AS nx FROM l GROUP BY v)
SELECT count(*) = 0 AS eliminates FROM l JOIN f USING (v) LEFT JOIN orr ON orr.src = least(u, nx) AND orr.dst = greatest(u, nx) WHERE u <> nx AND orr.src IS NULL""")
def order_check(spark, sf):
    """Rings of four lines or more are not eliminated by any order."""
    g = order_rings(spark, sf).written()
    good = chordal.is_elimination_order(g, chordal.low_degree_order(g))
    return spark.createDataFrame([(good,)], "eliminates boolean")


@query("SELECT count(*) AS placed, CAST(1 AS BIGINT) AS perfect, CAST(0 AS BIGINT) AS ring_chordal FROM lineitem")
def perfect_order(spark, sf):
    """The completed rings have a perfect elimination order; as they are, rings have none."""
    rings = order_rings(spark, sf).written()
    g = chordal.chordal_completion(rings, materialize(chordal.low_degree_order(rings))).written()
    order = materialize(chordal.perfect_elimination_order(g))
    return one_row(spark, placed=order.count(), perfect=chordal.is_elimination_order(g, order), ring_chordal=chordal.is_chordal(rings))


@query("SELECT CAST(0 AS BIGINT) AS vertices, CAST(0 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS parted, TRUE AS is_tree")
def tree_decomposition(spark, sf):
    g, order = _filled_rings(spark, sf)
    bags, tree = chordal.chordal_tree_decomposition(g, order)
    return chordal.check_decomposition(g, materialize(bags), materialize(tree))


@query(rules("bad_leaf", "bad_step", "bad_join", "roots_apart"))
def nice_tree(spark, sf):
    """Leaves have no child, steps one, joins two, and one node is the root."""
    g, order = _filled_rings(spark, sf)
    bags, tree = chordal.chordal_tree_decomposition(g, order)
    nice = materialize(chordal.nice_tree(materialize(bags), materialize(tree)))
    kids = nice.select("node_id", "op").join(nice.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")), "node_id", "left").fillna(0, ["n"])
    row = kids.agg(F.count_if((F.col("op") == "leaf") & (F.col("n") != 0)).alias("a"), F.count_if(F.col("op").isin("introduce", "forget") & (F.col("n") != 1)).alias("b"), F.count_if((F.col("op") == "join") & (F.col("n") != 2)).alias("c")).first()
    return one_row(spark, bad_leaf=row["a"], bad_step=row["b"], bad_join=row["c"], roots_apart=nice.where("parent_id IS NULL").count() - 1)


# -- isomorphism


def _trade_copies(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The sparse trade graph, a copy under other numbers, and the ring of nations."""
    g = _sparse_trade(spark, sf).written()
    n = g.vertex_count()
    turn = lambda c: (F.lit(n - 1) - F.col(c)).cast("int")
    ring = g.vertices.select("id", F.pmod(F.col("id") + 1, F.lit(n)).cast("int").alias("to"))
    v = g.vertices.select(F.lit(1).alias("graph_id"), "id")
    v = v.union(g.vertices.select(F.lit(2), turn("id"))).union(g.vertices.select(F.lit(3), "id"))
    e = g.edges.select(F.lit(1).alias("graph_id"), "src", "dst")
    e = e.union(g.edges.select(F.lit(2), turn("dst"), turn("src"))).union(ring.select(F.lit(3), F.least("id", "to"), F.greatest("id", "to")))
    return materialize(v), materialize(e)


def _wl_sql(depth: int) -> str:
    sql = f"WITH {SPT}, l0 AS (SELECT n_nationkey AS id, CAST(count(src) AS VARCHAR) AS label FROM nation LEFT JOIN sta ON src = n_nationkey GROUP BY 1)"
    for i in range(1, depth + 1):
        sql += f""", n{i} AS (SELECT a.src AS id, string_agg(b.label, ',' ORDER BY b.label) AS near FROM sta a JOIN l{i - 1} b ON b.id = a.dst GROUP BY 1),
l{i} AS (SELECT l.id, md5(l.label || '|' || coalesce(n.near, '')) AS label FROM l{i - 1} l LEFT JOIN n{i} n USING (id))"""
    return sql + f" SELECT id, label FROM l{depth}"


@query(_wl_sql(3))
def neighborhood_labels(spark, sf):
    v, e = _trade_copies(spark, sf)
    return isomorphism.wl_labels(v, e, 3).where("graph_id = 1").select("id", "label")


def _order_copies(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Each order's ring of lines as a graph of its own, twice its key, and a copy with its lines in reverse."""
    rows = materialize(numbered_lines(spark, sf))
    k = F.col("at") - F.col("first")
    to = (k + 1) % F.col("n")
    own = rows.select((2 * F.col("o")).alias("graph_id"), k.alias("id"), to.alias("to"), "n")
    copy = rows.select(2 * F.col("o") + 1, F.col("n") - 1 - k, F.col("n") - 1 - to, "n")
    both = materialize(own.union(copy))
    # of two lines each is the other's next, which is one edge
    edges = both.where("id <> `to` AND NOT (n = 2 AND id = 1)").select("graph_id", F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"))
    return both.select("graph_id", "id"), edges


@query(f"WITH {OR} SELECT CAST(2 * count(*) AS BIGINT) AS graphs, count(DISTINCT n) AS fingerprints FROM orn")
def graph_fingerprints(spark, sf):
    """Rings of lines and their copies: as many fingerprints as there are numbers of lines."""
    p = isomorphism.graph_fingerprints(*_order_copies(spark, sf))
    return p.agg(F.count(F.lit(1)).alias("graphs"), F.countDistinct("fingerprint").alias("fingerprints"))


@query("SELECT count(DISTINCT l_orderkey) AS pairs, count(*) AS mapped, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS unlike FROM lineitem")
def isomorphic_copy(spark, sf):
    """Every order's ring mapped on its copy, edge by edge, and none on the copy of the next order with another number of lines."""
    v, e = _order_copies(spark, sf)
    of = v.where("graph_id % 2 = 0").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    own = of.select(F.col("graph_id").alias("pair_id"), F.col("graph_id").alias("graph_a"), (F.col("graph_id") + 1).alias("graph_b"))
    other = of.join(of.toDF("next", "m"), F.col("next") == F.col("graph_id") + 2).where("n <> m").select(F.col("graph_id") + 1, "graph_id", F.col("next") + 1)
    m = materialize(isomorphism.find_isomorphism(own.union(other), v, e))
    good = m.where("pair_id % 2 = 0")
    a = e.where("graph_id % 2 = 0").join(good.toDF("graph_id", "src", "s"), ["graph_id", "src"]).join(good.toDF("graph_id", "dst", "d"), ["graph_id", "dst"])
    moved = a.select((F.col("graph_id") + 1).alias("graph_id"), F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
    wrong = e.where("graph_id % 2 = 1").exceptAll(moved.select("graph_id", "src", "dst")).count()
    found = good.agg(F.countDistinct("pair_id").alias("pairs"), F.count(F.lit(1)).alias("mapped")).first()
    return one_row(spark, pairs=found["pairs"], mapped=found["mapped"], wrong=wrong, unlike=m.where("pair_id % 2 = 1").count())


@query("SELECT CAST(1 AS BIGINT) AS holds, CAST(0 AS BIGINT) AS holds_reversed, CAST(0 AS BIGINT) AS holds_cut, count(*) AS mapped FROM lineitem")
def isomorphism_checked(spark, sf):
    """All orders' rings as one graph, mapped on a copy under other names; the check accepts that, but neither a mapping without a rule nor one with a row less."""
    g = order_rings(spark, sf).written()
    other = lambda c: (-2 * F.col(c) - 5).alias(c)
    copy = Graph(g.vertices.select(other("id")), g.edges.select(F.least(other("src"), other("dst")).alias("src"), F.greatest(other("src"), other("dst")).alias("dst"))).written()
    both = lambda of: of(g).withColumn("graph_id", F.lit(0)).union(of(copy).withColumn("graph_id", F.lit(1)))
    pair = spark.createDataFrame([(0, 0, 1)], "pair_id int, graph_a int, graph_b int")
    m = isomorphism.find_isomorphism(pair, both(lambda x: x.vertices.select("id")), both(lambda x: x.edges.select("src", "dst")))
    m = materialize(m.select("id_a", "id_b"))
    n = g.vertex_count()
    backward = g.vertices.select(F.col("id").alias("id_a"), (-2 * (F.lit(n - 1) - F.xxhash64("id") % 2 - F.col("id")) - 5).alias("id_b"))
    one_less = m.join(m.agg(F.min("id_a").alias("id_a")), "id_a", "left_anti")
    return one_row(spark, holds=isomorphism.check_isomorphism(g, copy, m), holds_reversed=isomorphism.check_isomorphism(g, copy, backward), holds_cut=isomorphism.check_isomorphism(g, copy, one_less), mapped=m.count())


# -- rotation systems


def _wheels(spark, sf) -> DataFrame:
    return materialize(order_wheels(spark, sf).select("vertex", "pos", "neighbor"))


@query(f"WITH {OW} SELECT -1 - o AS component, CASE WHEN n > 2 THEN 4 * n WHEN n = 2 THEN 6 ELSE 2 END AS darts FROM orn")
def rotation_parts(spark, sf):
    return rotation.rotation_components(_wheels(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("darts"))


@query(f"WITH {OW} SELECT vertex, CAST(row_number() OVER (PARTITION BY vertex ORDER BY pos) - 1 AS INT) AS pos, neighbor FROM w WHERE vertex >= 0 AND neighbor >= 0")
def rotation_of_rim(spark, sf):
    w = _wheels(spark, sf)
    return rotation.rotation_filter(w, w.where("vertex >= 0").select("vertex")).select("vertex", F.col("pos").cast("int").alias("pos"), "neighbor")


@query(f"WITH {OW} SELECT vertex * 10 AS vertex, pos, neighbor * 10 AS neighbor FROM w")
def rotation_renamed(spark, sf):
    w = _wheels(spark, sf)
    return rotation.rotation_relabel(w, w.select(F.col("vertex").alias("id"), (F.col("vertex") * 10).alias("name")).distinct())


@query(f"WITH {OW} SELECT vertex, CAST(count(*) OVER (PARTITION BY vertex) - 1 - pos AS INT) AS pos, neighbor FROM w")
def rotation_flipped(spark, sf):
    return rotation.flip(_wheels(spark, sf))


@query(f"WITH {OW} SELECT DISTINCT least(vertex, neighbor) AS src, greatest(vertex, neighbor) AS dst FROM w")
def rotation_edges(spark, sf):
    return rotation.rotation_to_graph(_wheels(spark, sf)).edges


@query(f"""WITH RECURSIVE {OW}, d AS (SELECT vertex, pos, neighbor, count(*) OVER (PARTITION BY vertex) AS n FROM w),
nx AS (SELECT a.neighbor AS a, a.vertex AS b, c.neighbor AS c FROM d a JOIN d c ON c.vertex = a.vertex AND c.pos = (a.pos + 1) % a.n),
r(a, b, x, y, step) AS (SELECT a, b, a, b, 0 FROM nx UNION ALL SELECT r.a, r.b, nx.b, nx.c, r.step + 1 FROM r JOIN nx ON nx.a = r.x AND nx.b = r.y WHERE NOT (nx.b = r.a AND nx.c = r.b)),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.a = r.a AND q.b = r.b AND (q.x < q.a OR (q.x = q.a AND q.y < q.b))))
SELECT a AS face_a, b AS face_b, CAST(step AS INT) AS step, x AS vertex FROM f UNION ALL SELECT a, b, CAST(max(step) + 1 AS INT), a FROM f GROUP BY a, b""")
def rotation_faces(spark, sf):
    return rotation.faces(_wheels(spark, sf))


@query("""WITH n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT o, n, CASE WHEN n > 2 THEN 2 * n WHEN n = 2 THEN 3 ELSE 1 END AS e FROM n)
SELECT -1 - o AS component, n + 1 AS v, CAST(e AS BIGINT) AS e, CAST(e - n + 1 AS BIGINT) AS f, TRUE AS planar FROM e""")
def euler_formula(spark, sf):
    return rotation.euler_check(_wheels(spark, sf))


@query("""WITH n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT o, n, CASE WHEN n > 2 THEN 4 * n WHEN n = 2 THEN 6 ELSE 2 END AS e FROM n)
SELECT -1 - o AS component, CAST(2 * n + 1 AS BIGINT) AS v, CAST(e AS BIGINT) AS e, CAST(e - 2 * n + 1 AS BIGINT) AS f, TRUE AS planar FROM e""")
def merged_wheels(spark, sf):
    """Each order's wheel twice, with one hub for both."""
    w = materialize(order_wheels(spark, sf))
    far = lambda c: F.when(F.col(c) >= 0, F.col(c) + (1 << 50)).otherwise(F.col(c))
    own = F.struct((2 * F.col("o")).alias("block"), "vertex", "pos", "neighbor")
    copy = F.struct((2 * F.col("o") + 1).alias("block"), far("vertex").alias("vertex"), "pos", far("neighbor").alias("neighbor"))
    return rotation.euler_check(rotation.merge_blocks(w.select(F.inline(F.array(own, copy)))))


@query("""WITH n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(sum(CASE WHEN n > 2 THEN 3 * n - 3 WHEN n = 2 THEN 3 ELSE 1 END) AS BIGINT) AS edges, CAST(0 AS BIGINT) AS large_faces, count(*) AS planar FROM n""")
def triangulated_wheel(spark, sf):
    """Every order's wheel filled with chords: three edges a vertex, less six."""
    t = materialize(rotation.triangulate(_wheels(spark, sf)))
    walks = rotation.faces(t)
    large = walks.groupBy("face_a", "face_b").agg(F.max("step").alias("n")).where("n > 3").count()
    return one_row(spark, edges=t.count() // 2, large_faces=large, planar=rotation.euler_check(t, walks).where("planar").count())


# -- layouts


@query(rules("off_mean", "moved"))
def barycentric_layout(spark, sf):
    """Each order's wheel with its rim on a circle: the hub lies at the mean of its neighbours."""
    g = rotation.rotation_to_graph(_wheels(spark, sf)).written()
    turn = F.col("id") % 7 * 0.8975979010256552
    rim = g.vertices.where("id >= 0").select("id", F.cos(turn).alias("x"), F.sin(turn).alias("y"))
    at = materialize(layout.tutte_layout(g, rim))
    mean = g.arcs.where("src < 0").join(at.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    off = at.where("id < 0").join(mean, "id", "left").where("coalesce(abs(x - mx) > 1e-6 OR abs(y - my) > 1e-6, true)").count()
    return one_row(spark, off_mean=off, moved=at.join(rim.toDF("id", "x0", "y0"), "id").where("x <> x0 OR y <> y0").count())


def _chain_layout(spark, sf) -> tuple[Graph, DataFrame]:
    """Chains of vectors of one label, at their first two components."""
    return labelled_chains(spark, sf).written(), vector_points(spark, sf)


@query(f"""WITH {LC}, {PTS}, e AS (SELECT src, dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM sim JOIN pts a ON a.id = src JOIN pts b ON b.id = dst),
c AS (SELECT p.src AS src_a, p.dst AS dst_a, q.src AS src_b, q.dst AS dst_b,
 ((p.x2-p.x1)*(q.y1-p.y1)-(p.y2-p.y1)*(q.x1-p.x1)) * ((p.x2-p.x1)*(q.y2-p.y1)-(p.y2-p.y1)*(q.x2-p.x1)) AS l,
 ((q.x2-q.x1)*(p.y1-q.y1)-(q.y2-q.y1)*(p.x1-q.x1)) * ((q.x2-q.x1)*(p.y2-q.y1)-(q.y2-q.y1)*(p.x2-q.x1)) AS r
 FROM e p JOIN e q ON (p.src < q.src OR (p.src = q.src AND p.dst < q.dst)) AND p.src <> q.src AND p.src <> q.dst AND p.dst <> q.src AND p.dst <> q.dst)
SELECT src_a, dst_a, src_b, dst_b FROM c WHERE l < 0 AND r < 0""")
def edge_crossings(spark, sf):
    return layout.edge_crossings(*_chain_layout(spark, sf))


@query(f"WITH {LC}, {PTS} SELECT src, dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS length FROM sim JOIN pts a ON a.id = src JOIN pts b ON b.id = dst")
def edge_lengths(spark, sf):
    return layout.edge_lengths(*_chain_layout(spark, sf)).select("src", "dst", F.round("length", 9).alias("length"))


@query(f"""WITH {LC}, l AS (SELECT 0 AS layout_id, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings UNION ALL SELECT 1, vec_id, CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE) FROM embeddings),
s AS (SELECT a.layout_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS m FROM sim JOIN l a ON a.id = src JOIN l b ON b.id = dst AND b.layout_id = a.layout_id GROUP BY 1)
SELECT layout_id, round(m, 9) AS shortest FROM s ORDER BY m DESC, layout_id LIMIT 1""")
def best_layout(spark, sf):
    g = labelled_chains(spark, sf).written()
    e = table(spark, sf, "embeddings")
    two = [e.select(F.lit(k).alias("layout_id"), F.col("vec_id").alias("id"), F.col("embedding")[2 * k].cast("double").alias("x"), F.col("embedding")[2 * k + 1].cast("double").alias("y")) for k in (0, 1)]
    return layout.best_layout(g, two[0].union(two[1])).select("layout_id", F.round("shortest", 9).alias("shortest"))


@query(f"""WITH {PTS}, b AS (SELECT min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM pts), s AS (SELECT *, least((1600 - 80.0) / (x9 - x0), (900 - 80.0) / (y9 - y0)) AS s FROM b),
p AS (SELECT *, greatest(40.0, (1600 - (x9 - x0) * s) / 2) AS px, greatest(40.0, (900 - (y9 - y0) * s) / 2) AS py FROM s)
SELECT id, round((x - x0) * s + px, 6) AS x, round(900 - ((y - y0) * s + py), 6) AS y FROM pts, p""")
def scaled_layout(spark, sf):
    return layout.normalize_layout(vector_points(spark, sf), 1600, 900, 40.0).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 0.75 + CAST(embedding[3] AS DOUBLE) * 0.25, 9) AS x, round(CAST(embedding[2] AS DOUBLE) * 0.75 + CAST(embedding[4] AS DOUBLE) * 0.25, 9) AS y FROM embeddings")
def blended_layout(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])
    mixed = layout.interpolate_layouts(e.select("id", "e0", "e1"), e.select("id", "e2", "e3"), 0.25)
    return mixed.select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


# -- column functions


@query("SELECT vec_id, round(sqrt((CAST(embedding[1] AS DOUBLE) - CAST(embedding[3] AS DOUBLE)) * (CAST(embedding[1] AS DOUBLE) - CAST(embedding[3] AS DOUBLE)) + (CAST(embedding[2] AS DOUBLE) - CAST(embedding[4] AS DOUBLE)) * (CAST(embedding[2] AS DOUBLE) - CAST(embedding[4] AS DOUBLE))), 9) AS dist FROM embeddings")
def euclidean_distance(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    return table(spark, sf, "embeddings").select("vec_id", F.round(euclidean(*e), 9).alias("dist"))


_RAD = lambda c: f"(pi() * (floor({c}) + 5.0 * ({c} - floor({c})) / 3.0) / 180.0)"


@query(f"""WITH g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 90 AS a, CAST(embedding[2] AS DOUBLE) * 180 AS b, CAST(embedding[3] AS DOUBLE) * 90 AS c, CAST(embedding[4] AS DOUBLE) * 180 AS d FROM embeddings)
SELECT vec_id, round(6378.388 * acos(least(greatest(cos({_RAD("a")}) * cos({_RAD("c")}) * cos({_RAD("b")} - {_RAD("d")}) + sin({_RAD("a")}) * sin({_RAD("c")}), -1.0), 1.0)) + 0.5) AS km FROM g""")
def geo_distance(spark, sf):
    e = [F.col("embedding")[i].cast("double") * s for i, s in enumerate((90, 180, 90, 180))]
    return table(spark, sf, "embeddings").select("vec_id", tsplib_geo_distance(*e).alias("km"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
o AS (SELECT vec_id, (v[3]-v[1])*(v[6]-v[2])-(v[4]-v[2])*(v[5]-v[1]) AS a, (v[3]-v[1])*(v[8]-v[2])-(v[4]-v[2])*(v[7]-v[1]) AS b,
 (v[7]-v[5])*(v[2]-v[6])-(v[8]-v[6])*(v[1]-v[5]) AS c, (v[7]-v[5])*(v[4]-v[6])-(v[8]-v[6])*(v[3]-v[5]) AS d FROM g)
SELECT vec_id, CAST(sign(a) AS INT) AS turn, a * b < 0 AND c * d < 0 AS crosses FROM o""")
def segment_tests(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(8)]
    return table(spark, sf, "embeddings").select(
        "vec_id", F.signum(orientation(*e[:6])).cast("int").alias("turn"), segments_cross((e[0], e[1]), (e[2], e[3]), (e[4], e[5]), (e[6], e[7])).alias("crosses")
    )
