"""Graphs from rules and from random numbers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.operators.graph import Graph
from arcwise.storage import dealt, materialize


def complete_graph(vertices: DataFrame, max_vertices: int | None = 10_000, block: int = 1_000_000) -> Graph:
    """All pairs; more than ``max_vertices`` is an error unless that is None, since edges grow with the square.

    Vertices are dealt so that a task makes some 50 million pairs. Every task meets all vertices, which are broadcast in blocks of
    ``block``, so no pair is shuffled and a task holds one block at a time.
    """
    ids = materialize(vertices.select(F.col(vertices.columns[0]).alias("id")).distinct(), "ids")
    n = ids.count()
    if max_vertices is not None and n > max_vertices:
        raise ValueError(f"more than {max_vertices} vertices")
    spread = ids.repartition(max(1, min(n, max(4 * ids.sparkSession.sparkContext.defaultParallelism, n * n // 100_000_000)))).select(F.col("id").alias("src"))
    blocks = [ids]
    if n > block:
        placed = materialize(with_global_index(ids, ["id"], "at"), "ids")
        blocks = [placed.where(f"at div {block} = {k}").select("id") for k in range(-(-n // block))]
    pairs = [spread.join(F.broadcast(b.select(F.col("id").alias("dst"))), F.col("src") < F.col("dst")) for b in blocks]
    return Graph(ids, reduce(DataFrame.union, pairs))


def edges_from_comembership(df: DataFrame, member: str, group: str, max_group: int = 10_000) -> DataFrame:
    """``src, dst``: every two members of a common group; a group over ``max_group`` is an error."""
    rows = df.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL AND m IS NOT NULL")
    rows = dealt(rows, df.count(), "g").distinct()
    n = F.col("count")
    largest, pairs = rows.groupBy("g").count().agg(F.max(n), F.sum((n * (n - 1) / 2).cast("long"))).first()
    if (largest or 0) > max_group:
        raise ValueError(f"a group has {largest} members")
    a, b = (rows.select("g", F.col("m").alias(end)) for end in ("src", "dst"))
    return dealt(a.join(b, "g").where("src < dst").select("src", "dst"), pairs, "src", "dst").distinct()


def _draw(seed: int, *parts) -> F.Column:
    """A number from 0 up to 1 that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / float(1 << 53)


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """``src < dst`` of n vertices: one row for each vertex, spread, then its later ones."""
    base = spark.range(n).select(F.col("id").alias("src")).where(F.col("src") < n - 1)
    return base.select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))


def random_graph_p(spark: SparkSession, n: int, p: float, seed: int = 1, block: int = 100_000) -> Graph:
    """Each pair is an edge with chance p.

    All pairs are numbered by their larger end, and cut into ranges of numbers that hold some ``block`` edges. Each range draws the
    gaps between its edges by itself, so the work follows the edges, and none is shuffled.
    """
    whole = n * (n - 1) // 2
    if p <= 0 or whole <= 0:
        return Graph(spark.range(max(n, 0)), _pairs(spark, 2).limit(0))
    if p >= 1:
        return Graph(spark.range(n), _pairs(spark, n))
    wide = max(1, min(int(block / p), whole, 1 << 62))
    ranges = -(-whole // wide)
    starts = spark.range(0, ranges, 1, min(ranges, max(spark.sparkContext.defaultParallelism, ranges // 50)))

    def drawn(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng, at, end = np.random.default_rng([seed, k]), k * wide - 1, min((k + 1) * wide, whole)
                while at < end:
                    # a gap past the range ends it, whatever its length
                    gaps = np.minimum(rng.geometric(p, 65_536).astype(np.int64), min(wide + 1, (1 << 62) // 65_536))
                    pairs = at + np.cumsum(gaps)
                    at = int(pairs[-1])
                    pairs = pairs[pairs < end]
                    # pair x * (x - 1) / 2 + y is that of y < x; the root may be one off
                    x = ((1 + np.sqrt(1 + 8 * pairs.astype(np.float64))) / 2).astype(np.int64)
                    x -= x * (x - 1) // 2 > pairs
                    x += x * (x + 1) // 2 <= pairs
                    yield pa.RecordBatch.from_arrays([pa.array(pairs - x * (x - 1) // 2), pa.array(x)], names=["src", "dst"])

    return Graph(spark.range(n), starts.mapInArrow(drawn, "src long, dst long"))


def random_graph_m(spark: SparkSession, n: int, m: int, seed: int = 1) -> Graph:
    """m different pairs; more than there are is an error.

    Pairs are drawn by hash of their turn, and the m that come first stay, so the work follows m. Of more than half of all
    pairs those that are left out are drawn.
    """
    whole = n * (n - 1) // 2
    if m > whole:
        raise ValueError(f"{n} vertices have fewer than {m} pairs")
    if 2 * m > whole:
        gone = random_graph_m(spark, n, whole - m, seed).edges if m < whole else _pairs(spark, 2).limit(0)
        return Graph(spark.range(n), _pairs(spark, max(n, 2)).join(gone, ["src", "dst"], "left_anti") if n > 1 else _pairs(spark, 2).limit(0))
    turns = m + m // 4 + 16
    while True:
        a = F.pmod(F.xxhash64(F.lit(seed), F.lit("a"), "id"), F.lit(n))
        b = F.pmod(F.xxhash64(F.lit(seed), F.lit("b"), "id"), F.lit(max(n - 1, 1)))
        drawn = spark.range(turns).select("id", a.alias("x"), b.alias("y")).withColumn("y", F.col("y") + (F.col("y") >= F.col("x")).cast("long"))
        first = materialize(drawn.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.min("id").alias("turn")))
        if m == 0 or first.count() >= m:
            placed = with_global_index(first, ["turn"], "at")
            return Graph(spark.range(n), placed.where(F.col("at") < m).select("src", "dst"))
        turns *= 2


def random_k_tree(spark: SparkSession, n: int, k: int, delete_prob: float = 0.0, seed: int = 1) -> Graph:
    """A random k-tree, of which each edge is then taken out with a chance.

    Vertices 0 to k are all linked. A later vertex i links to a random earlier
    k-clique: one of the k + 1 of the first clique, or one of the k that some
    earlier vertex made, which is that vertex and its own clique but for one.
    The cliques are made out in rounds, each for the vertices whose owner is
    known; rounds grow with the logarithm of n.
    """
    if n < k + 1:
        raise ValueError("a k-tree needs k + 1 vertices")
    first = F.sequence(F.lit(0).cast("long"), F.lit(k).cast("long"))
    late = spark.range(k + 1, n).withColumn("c", F.pmod(F.xxhash64(F.lit(seed), "id"), (k + 1) + k * (F.col("id") - k - 1)))
    base = F.col("c") <= k
    owner = F.when(~base, k + 1 + F.floor((F.col("c") - k - 1) / k).cast("long"))
    which = F.when(base, F.col("c")).otherwise(F.pmod(F.col("c") - k - 1, F.lit(k))).cast("int")
    rows = materialize(late.select("id", owner.alias("owner"), which.alias("skip")))
    drop = lambda a: F.filter(a, lambda x, i: i != F.col("skip"))
    done = materialize(rows.where("owner IS NULL").select("id", drop(first).alias("clique")))
    new, left = done, rows.where("owner IS NOT NULL")
    while left.limit(1).count():
        own = new.select(F.col("id").alias("owner"), F.col("clique").alias("oc"))
        step = materialize(left.join(own, "owner").select("id", F.concat(drop(F.col("oc")), F.array("owner")).alias("clique")))
        left = materialize(left.join(step, "id", "left_anti"))
        done, new = materialize(done.union(step)), step
    edges = done.select(F.explode("clique").alias("src"), F.col("id").alias("dst"))
    edges = edges.union(_pairs(spark, k + 1) if k else edges.limit(0))
    return Graph(spark.range(n), edges.where(_draw(seed + 1, "src", "dst") >= delete_prob))
