"""Graphs and points out of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.operators.graph import Graph
from arcwise.storage import materialize


def read_tsplib_points(spark: SparkSession, path: str) -> DataFrame:
    """``file, id, x, y`` of the lines after NODE_COORD_SECTION until EOF or an empty line, in each file.

    Files may be split into blocks: a line's place is its block and its turn in it, so no file is held as a whole. A
    file without the section and a line without three fields, two of them numbers, are errors.
    """
    # fixed values: the words of the format
    opens, ends = "NODE_COORD_SECTION", "EOF"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn")).alias("at"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"))
    lines = materialize(lines, "lines")
    start = lines.groupBy("file").agg(F.min(F.when(F.upper("line") == opens, F.col("at"))).alias("start"))
    if start.where("start IS NULL").limit(1).count():
        raise ValueError(f"no {opens}")
    body = lines.join(start, "file").where("at > start")
    stop = body.where((F.upper("line") == ends) | (F.col("line") == "")).groupBy("file").agg(F.min("at").alias("stop"))
    inside = body.join(stop, "file", "left").where("stop IS NULL OR at < stop")
    parts = F.split("line", " +")
    parsed = materialize(inside.select("file", "at", "line", F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).try_cast("double").alias("x"), F.get(parts, F.lit(2)).try_cast("double").alias("y")))
    bad = parsed.where("n <> 3 OR x IS NULL OR y IS NULL").agg(F.min_by("line", F.struct("file", "at"))).first()[0]
    if bad is not None:
        raise ValueError(f"not a line of coordinates: {bad}")
    return parsed.select("file", "id", "x", "y")


def edges_from_markup(df: DataFrame, text: str, pair_regex: str, vertex_regex: str) -> Graph:
    """A graph from all matches: a pair's two groups are an edge's ends, a vertex's group an id."""
    pairs = df.select(F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pair_regex), 1).alias("a"), F.regexp_extract_all(text, F.lit(pair_regex), 2).alias("b"))).alias("p"))
    singles = df.select(F.explode(F.regexp_extract_all(text, F.lit(vertex_regex), 1)).alias("id"))
    return Graph.from_edges(pairs.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")), vertices=singles)
