"""Multigraphs: ``edges`` has ``src < dst`` and a positive ``count``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators.graph import Graph, canonical


class MultiGraph:
    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges

    @classmethod
    def from_edges(cls, df: DataFrame, vertices: DataFrame | None = None) -> MultiGraph:
        """Parallel edges of ``src, dst`` (and ``count``, else 1 a row) are summed."""
        if df.where("src IS NULL OR dst IS NULL OR src = dst").limit(1).count():
            raise ValueError("an edge needs two different ends")
        rows = df if "count" in df.columns else df.withColumn("count", F.lit(1))
        edges = canonical(rows.select("src", "dst", "count")).groupBy("src", "dst").agg(F.sum("count").cast("long").alias("count"))
        edges = edges.where("count > 0")
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        if vertices is not None:
            ends = ends.union(vertices.select(vertices.columns[0]))
        return cls(ends.distinct(), edges)

    @classmethod
    def from_graph(cls, g: Graph) -> MultiGraph:
        return cls(g.vertices, g.edges.select("src", "dst", F.lit(1).cast("long").alias("count")))

    def edge_count(self) -> int:
        return self.edges.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    def degrees(self) -> DataFrame:
        """``id, degree`` with parallel edges counted."""
        ends = self.edges.select(F.col("src").alias("id"), "count").union(self.edges.select("dst", "count"))
        total = ends.groupBy("id").agg(F.sum("count").alias("degree"))
        return self.vertices.join(total, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def edges_at(self, ids: DataFrame) -> DataFrame:
        return Graph(self.vertices, self.edges).edges_at(ids)

    def contains(self, pairs: DataFrame) -> DataFrame:
        """``src, dst, count`` of the asked pairs, 0 where there is no edge."""
        here = self.edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), "count")
        match = (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b"))
        return pairs.select("src", "dst").join(here, match, "left").select("src", "dst", F.coalesce("count", F.lit(0)).cast("long").alias("count"))

    def add_edges(self, df: DataFrame) -> MultiGraph:
        more = df if "count" in df.columns else df.withColumn("count", F.lit(1))
        return MultiGraph.from_edges(self.edges.union(more.select("src", "dst", "count")), self.vertices)

    def remove_edges(self, df: DataFrame) -> tuple[MultiGraph, DataFrame]:
        """Without the given counts, and ``src, dst, removed``: no edge loses more than it has."""
        less = df if "count" in df.columns else df.withColumn("count", F.lit(1))
        asked = canonical(less.select("src", "dst", "count")).groupBy("src", "dst").agg(F.sum("count").alias("asked"))
        both = self.edges.join(asked, ["src", "dst"], "left").withColumn("removed", F.least("count", F.coalesce("asked", F.lit(0))))
        left = both.select("src", "dst", (F.col("count") - F.col("removed")).alias("count")).where("count > 0")
        return MultiGraph(self.vertices, left), both.where("removed > 0").select("src", "dst", "removed")

    def remove_vertices(self, ids: DataFrame) -> MultiGraph:
        g = Graph(self.vertices, self.edges).remove_vertices(ids)
        return MultiGraph(g.vertices, g.edges)

    def relabel(self, names: DataFrame) -> MultiGraph:
        """New names from ``id, name``; counts of edges that fall together add up; an edge that becomes a loop is an error."""
        a, b = (names.select(F.col("id").alias(end), F.col("name").alias(f"_{end}")) for end in ("src", "dst"))
        edges = self.edges.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "count")
        return MultiGraph.from_edges(edges, self.vertices.join(names, "id").select(F.col("name").alias("id")))
