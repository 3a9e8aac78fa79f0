"""Undirected simple graphs as two DataFrames.

``vertices`` has ``id``; ``edges`` has ``src < dst``, one row for each edge, and
any further columns. Every operation returns a new graph or table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.storage import dealt, materialize


def canonical(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with the smaller end first; other columns stay."""
    rest = [c for c in df.columns if c not in (src, dst)]
    return df.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), *rest)


def _ends(edges: DataFrame, rows: int | None) -> DataFrame:
    return dealt(edges.select(F.explode(F.array("src", "dst")).alias("id")), rows, "id").distinct()


class Graph:
    def __init__(self, vertices: DataFrame, edges: DataFrame, rows: int | None = None):
        """``rows``, if known, is about how many edges there are; steps on large graphs are dealt into more parts by it."""
        self.vertices, self.edges, self.rows = vertices, edges, rows
        self._only_ends = False
        # small components in bundles, and those with the places of an order (``operators/bundles.py``)
        self.packed = self.ordered = None

    # -- building

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None) -> Graph:
        """A graph of the pairs of ``df``; ends are added to ``vertices``.

        Of rows for the same edge, that with the least further columns stays.
        Rows with a null end are an error, as are those with equal ends.
        """
        bad = df.where(F.col(src).isNull() | F.col(dst).isNull() | (F.col(src) == F.col(dst))).limit(1).count()
        if bad:
            raise ValueError("an edge needs two different ends")
        pairs = canonical(df, src, dst)
        rest = pairs.columns[2:]
        if rest:
            least = pairs.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_least"))
            pairs = least.select("src", "dst", *[F.col("_least")[c].alias(c) for c in rest])
        else:
            pairs = pairs.distinct()
        ends = pairs.select(F.col("src").alias("id")).union(pairs.select("dst"))
        if vertices is not None:
            ends = ends.union(vertices.select(vertices.columns[0]))
        return cls(ends.distinct(), pairs)

    @classmethod
    def of_distinct(cls, edges: DataFrame, rows: int | None = None) -> Graph:
        """A graph of edges that are known to be distinct, with ``src < dst``; they are neither tested nor grouped again."""
        g = cls(_ends(edges, rows), edges, rows)
        g._only_ends = True
        return g

    def written(self) -> Graph:
        """The same graph from tables in the shared folder, so that loops read it and don't compute it again."""
        edges = materialize(self.edges)
        if self._only_ends:  # from the table, or the edges would be computed twice
            n = edges.count()
            return Graph(materialize(_ends(edges, n)), edges, n)
        g = Graph(materialize(self.vertices), edges, self.rows)
        g.packed, g.ordered = self.packed, self.ordered
        return g

    # -- views

    @property
    def arcs(self) -> DataFrame:
        """Each edge in both directions."""
        rest = self.edges.columns[2:]
        return self.edges.select("src", "dst", *rest).union(self.edges.select("dst", "src", *rest).toDF("src", "dst", *rest))

    @property
    def adjacency(self) -> DataFrame:
        """``id, neighbors``: a sorted list for each vertex with an edge."""
        return self.arcs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))

    def edge_count(self) -> int:
        return self.edges.count()

    def vertex_count(self) -> int:
        return self.vertices.count()

    def is_complete(self) -> bool:
        n = self.vertex_count()
        return self.edge_count() == n * (n - 1) // 2

    def degrees(self) -> DataFrame:
        """``id, degree`` of every vertex, 0 included."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).alias("n"))
        both = self.vertices.select("id", F.lit(0).alias("n")).union(ends)
        return dealt(both, self.rows, "id").groupBy("id").agg(F.sum("n").alias("degree"))

    def odd_vertices(self) -> DataFrame:
        return self.degrees().where("degree % 2 = 1").select("id")

    def neighbors(self, ids: DataFrame) -> DataFrame:
        """``id, neighbor`` for the given vertices."""
        wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        return self.arcs.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).join(wanted, "id", "left_semi")

    def edges_at(self, ids: DataFrame) -> DataFrame:
        """Edges that touch any of the given vertices."""
        wanted = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
        at = dealt(self.edges, self.rows, "dst").join(wanted.withColumnRenamed("_id", "_b"), F.col("dst") == F.col("_b"), "left")
        at = dealt(at, self.rows, "src").join(wanted.withColumnRenamed("_id", "_a"), F.col("src") == F.col("_a"), "left")
        return at.where("_a IS NOT NULL OR _b IS NOT NULL").select(*self.edges.columns)

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        """``src, dst, present`` for each asked pair, in its own direction."""
        here = self.edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        match = (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b"))
        return pairs.select("src", "dst").join(here, match, "left").select("src", "dst", F.col("_a").isNotNull().alias("present"))

    def contains_vertices(self, ids: DataFrame) -> DataFrame:
        here = self.vertices.select(F.col("id").alias("_id"))
        asked = ids.select(F.col(ids.columns[0]).alias("id"))
        return asked.join(here, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("present"))

    # -- set operations

    def add_vertices(self, ids: DataFrame) -> Graph:
        return Graph(self.vertices.union(ids.select(ids.columns[0])).distinct(), self.edges)

    def add_edges(self, pairs: DataFrame) -> Graph:
        """With the given edges and their ends; edges that are there already stay as they are."""
        more = canonical(pairs.select("src", "dst", *self.edges.columns[2:])).dropDuplicates(["src", "dst"])
        fresh = more.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti").select(*self.edges.columns)
        ends = more.select("src").union(more.select("dst"))
        return Graph(self.vertices.union(ends).distinct(), self.edges.union(fresh))

    def union(self, other: Graph) -> Graph:
        return self.add_edges(other.edges).add_vertices(other.vertices)

    def remove_vertices(self, ids: DataFrame) -> Graph:
        gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        edges = self.edges
        for end in ("src", "dst"):
            edges = dealt(edges, self.rows, end).join(gone.withColumnRenamed("id", end), end, "left_anti")
        return Graph(self.vertices.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        gone = canonical(pairs.select("src", "dst")).distinct()
        return Graph(self.vertices, self.edges.join(gone, ["src", "dst"], "left_anti").select(*self.edges.columns))

    def induced(self, kept) -> Graph:
        """The part inside a set of vertices, given as a table or as a condition on ``id``."""
        if not isinstance(kept, DataFrame):
            kept = self.vertices.where(kept)
        inside = kept.select(F.col(kept.columns[0]).alias("id")).distinct()
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(inside.withColumnRenamed("id", end), end, "left_semi")
        return Graph(self.vertices.join(inside, "id", "left_semi"), edges.select(*self.edges.columns))

    def relabel(self, names: DataFrame) -> Graph:
        """New names for all vertices, from ``id, name``; two vertices of one name are an error."""
        named = self.vertices.join(names.select("id", "name"), "id", "left")
        row = named.agg(F.count(F.lit(1)), F.count("name"), F.countDistinct("name")).first()
        if not row[0] == row[1] == row[2]:
            raise ValueError("each vertex needs a name of its own")
        rest = self.edges.columns[2:]
        a, b = (names.select(F.col("id").alias(end), F.col("name").alias(f"_{end}")) for end in ("src", "dst"))
        edges = self.edges.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)
        return Graph(named.select(F.col("name").alias("id")), canonical(edges))

    def equals(self, other: Graph) -> bool:
        """Whether both have the same vertices and the same edges."""
        mine, theirs = self.edges.select("src", "dst"), other.edges.select("src", "dst")
        apart = [self.vertices.exceptAll(other.vertices), other.vertices.exceptAll(self.vertices), mine.exceptAll(theirs), theirs.exceptAll(mine)]
        return not reduce(lambda a, b: a + b, (d.limit(1).count() for d in apart))

    # -- derived graphs

    def line_graph(self) -> DataFrame:
        """``src_a, dst_a, src_b, dst_b``: pairs of edges that share an end, the smaller first."""
        e = F.struct("src", "dst")
        at = self.edges.select(F.col("src").alias("v"), e.alias("e")).union(self.edges.select(F.col("dst").alias("v"), e.alias("e")))
        pairs = at.alias("a").join(at.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.e") < F.col("b.e")))
        return pairs.select(
            F.col("a.e.src").alias("src_a"), F.col("a.e.dst").alias("dst_a"), F.col("b.e.src").alias("src_b"), F.col("b.e.dst").alias("dst_b")
        )

    def cut_set(self, ids: DataFrame) -> DataFrame:
        """Edges with exactly one end in the set."""
        inside = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
        a, b = inside.select(F.col("_id").alias("_a")), inside.select(F.col("_id").alias("_b"))
        flagged = self.edges.join(a, F.col("src") == F.col("_a"), "left").join(b, F.col("dst") == F.col("_b"), "left")
        return flagged.where(F.col("_a").isNull() != F.col("_b").isNull()).select(*self.edges.columns)

    def split(self, ids: DataFrame) -> tuple[Graph, Graph, DataFrame]:
        """The graph inside the set, the graph outside, and the edges between; unknown ids are ignored."""
        return self.induced(ids), self.remove_vertices(ids), self.cut_set(ids)
