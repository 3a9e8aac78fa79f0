"""Exact top-k by inner product with norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.llm.tables import read
from arcwise.storage import materialize

#: Vectors in a block, or queries in a group; logarithmic width of a length class; vectors in the first run of a block
#: (each later run has as many as all before); coordinates that a step of pruning adds; queries and vectors that tune a block.
BLOCK, WIDTH, FIRST, STEP, TUNERS, TUNED = 8192, 0.05, 256, 8, 6, 128
SAFE = 1 << 22  # components up to this give exact products in doubles, for up to 512 of them
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score long, verified long, met long"


def scaled(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v, len``: components floor(1024 x), and the vector's length.

    Rows with a null id, and vectors that are null or hold a null, NaN or infinite component, are left
    out. Components past the range of a long stop at its ends.
    """
    whole = F.col(column).isNotNull() & F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    limit = float(1 << 62)
    parts = F.transform(column, lambda x: F.floor(F.greatest(F.least(1024 * x.cast("double"), F.lit(limit)), F.lit(-limit))).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.withColumn("len", F.sqrt(square))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers; past the range of a long they stop at its ends."""
    largest = max(np.abs(rows).max(initial=0), np.abs(q).max(initial=0))
    if largest <= SAFE and len(q) <= 512:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], ~scores[near]))][:k]
    return np.lexsort((ids, ~scores))[:k]


class Bucket:
    """One block of candidates of about one length, searched for one query at a time."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, length: np.ndarray):
        order = np.lexsort((ids, -length))
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self.unit = np.asfortranarray(self.rows / np.maximum(self.length, 1e-300)[:, None])
        self.switch = np.inf

    def _steps(self, q: np.ndarray, qlen: float):
        """The query's coordinates from the largest on, in steps, each with the length that is left of the query after it."""
        own = q / max(qlen, 1e-300)
        order = np.argsort(-np.abs(own), kind="stable")
        rest = np.sqrt(np.maximum(0.0, 1 - np.cumsum(own[order] ** 2)))
        for at in range(0, len(q), STEP):
            use = order[at : at + STEP]
            yield use, own[use], rest[min(at + STEP, len(q)) - 1]

    def by_coordinates(self, live: np.ndarray, q: np.ndarray, qlen: float, need: float) -> tuple[np.ndarray, int]:
        """Which of ``live`` can reach ``need`` (a threshold over the query's length), and how many partial products that took.

        Partial products over the query's largest coordinates, and what lengths of the rest the two have, bound the
        whole product by Cauchy and Schwarz.
        """
        part, square, work = np.zeros(len(live)), np.zeros(len(live)), 0
        for use, own, rest in self._steps(q, qlen):
            if len(live) <= FIRST // 8:
                break
            x = self.unit[np.ix_(live, use)]
            work += x.size
            part += x @ own
            square += np.einsum("ij,ij->i", x, x)
            bound = part + rest * np.sqrt(np.maximum(0.0, 1 - square)) + SLACK
            keep = bound * self.length[live] >= need * (1 - SLACK)
            live, part, square = live[keep], part[keep], square[keep]
        return live, work

    def tune(self, queries: list[tuple[np.ndarray, float, float]]) -> None:
        """Set the local cosine threshold from which pruning by coordinates pays, by trying it on some queries and vectors."""
        some = np.arange(0, len(self.ids), max(1, len(self.ids) // TUNED))
        needs = [(share * t / max(qlen, 1e-300), q, qlen) for q, qlen, t in queries[:TUNERS] if t > 0 for share in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]
        for need, q, qlen in needs:
            left, work = self.by_coordinates(some, q, qlen, need)
            if work + len(left) * len(q) < len(some) * len(q):
                self.switch = min(self.switch, need / max(self.length[0], 1e-300))

    def search(self, qid: int, q: np.ndarray, qlen: float, threshold: float | None, k: int) -> tuple[list, int]:
        """The best ``k`` (vec_id, score), and how many products were multiplied out.

        The threshold rises with what earlier runs of the block have found. A local one over 1 leaves the run
        out; a low one cuts it by length, one past the block's switch by coordinates too.
        """
        ids, scores, verified, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        known = -np.inf if threshold is None or np.isnan(threshold) else threshold
        while at < len(self.ids):
            to = min(len(self.ids), max(at + FIRST, 2 * at))
            live = np.arange(at, to)
            if known > 0:
                need = known / max(qlen, 1e-300)
                live = live[: int(np.searchsorted(-self.length[at:to], -need * (1 - SLACK), "right"))]
                if len(live) and need / max(self.length[live[0]], 1e-300) >= self.switch:
                    live, _ = self.by_coordinates(live, q, qlen, need)
            live = live[self.ids[live] != qid]
            verified += len(live)
            ids, scores = np.concatenate([ids, self.ids[live]]), np.concatenate([scores, _products(q, self.rows[live])])
            best = _best(ids, scores, k)
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                known = max(known, float(scores[-1]))
            at = to
        return list(zip(ids.tolist(), scores.tolist(), strict=True)), verified


def search_block(k: int):
    """The best of one block of candidates for the queries that are sent to it, and for each a row of its costs."""

    def run(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            dims = max(map(len, [*candidates.v, *queries.v]))
            bucket = Bucket(candidates.vec_id.to_numpy(), _matrix(candidates.v, dims), candidates.len.to_numpy())
            asked = list(zip(queries.query_id.tolist(), _matrix(queries.v, dims), queries.len.tolist(), queries.threshold.tolist(), strict=True))
            # where no threshold is known, some queries are searched in full to tune the block
            own = lambda i, q, n: float(min((s for _, s in bucket.search(i, q, n, None, k)[0]), default=0))
            known = [(q, n, own(i, q, n) if t is None or np.isnan(t) else t) for i, q, n, t in asked[:: max(1, len(asked) // TUNERS)]]
            bucket.tune(known)
            for qid, q, qlen, threshold in asked:
                best, verified = bucket.search(qid, q, qlen, threshold, k)
                out += [(qid, i, s, None, None) for i, s in best] + [(qid, None, None, verified, len(candidates))]
        names = ("query_id", "vec_id", "score", "verified", "met")
        return pd.DataFrame({name: pd.array([row[i] for row in out], "Int64") for i, name in enumerate(names)})

    return run


def _met(rows: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    shared = ["c", "part", "g"]
    return rows.groupBy(*shared).cogroup(sent.groupBy(*shared)).applyInPandas(search_block(k), FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, vec_id, score`` that can be among the best, and rows ``query_id, verified, met`` of costs.

    Candidates fall into classes by the logarithm of their length, and classes into blocks by hash, so equal vectors and
    equal lengths spread. Each query first meets one block of its best class, which gives it a threshold. Queries are
    then dealt into groups in the order of what length of candidate they need, and a class is sent only to the groups, and
    met only by the queries, whose need its longest vector reaches; so pairs of blocks go before any row is sent.
    """
    spark = vectors.sparkSession
    length_class = F.when(F.col("len") > 0, F.floor(F.log("len") / WIDTH)).otherwise(-100_000).cast("int")
    rows = materialize(vectors.withColumn("c", length_class), "vectors")
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "len")).alias("q")).select("query_id", "q.*")
    asked = materialize(asked, "asked")
    # a length class for each WIDTH of the logarithm: some 30,000 for all lengths a double can have
    sizes = sorted(((r["c"], r["n"], r["longest"]) for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")).collect()), reverse=True)
    if not sizes:
        return spark.createDataFrame([], FOUND)
    blocks = [(c, -(-n // BLOCK), longest) for c, n, longest in sizes]
    table = spark.createDataFrame(blocks, "c int, n int, longest double")
    rows = rows.join(F.broadcast(table.select("c", "n")), "c").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("n")).cast("int"))
    # the longest class with some vectors more than asked for, else the largest one
    home = next((c for c, n, _ in sizes if n >= 4 * k), max(sizes, key=lambda s: s[1])[0])
    n_home = next(n for c, n, _ in blocks if c == home)
    total = asked.count()
    share = max(1, -(-total // (BLOCK * n_home)))
    at_home = asked.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit("home")), F.lit(n_home)).cast("int")).withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(share)).cast("int"))
    sent = at_home.select("query_id", "v", "len", F.lit(None).cast("double").alias("threshold"), F.lit(home).alias("c"), "part", "g")
    copies = rows.where(F.col("c") == home).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
    first = materialize(_met(copies, sent, k), "first")
    least = first.where("vec_id IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    # as many as asked for give a threshold; need is the shortest candidate that can reach it
    ranked = at_home.withColumnRenamed("part", "home_part").drop("g").join(least, "query_id", "left").withColumn("threshold", F.when(F.col("n") >= k, F.col("least")))
    need = F.when((F.col("threshold") > 0) & (F.col("len") > 0), F.col("threshold") * (1 - SLACK) / F.col("len")).otherwise(0.0)
    placed = with_global_index(ranked.withColumn("need", need), [F.desc("need"), "query_id"], "at")
    placed = materialize(placed.withColumn("g", F.floor(F.col("at") / BLOCK).cast("int")), "placed")
    listed = F.array_sort(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n"), F.lit(longest).alias("longest")) for c, n, longest in blocks]))
    reached = lambda need: F.filter(listed, lambda s: s["longest"] >= F.col(need))
    groups = placed.groupBy("g").agg(F.min("need").alias("low")).withColumn("s", F.explode(reached("low"))).select("g", F.col("s.c").alias("c"))
    groups = materialize(groups, "groups")
    sent = placed.withColumn("s", F.explode(reached("need"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("s.n") - 1)))
    sent = sent.where((F.col("s.c") != home) | (F.col("part") != F.col("home_part"))).select("query_id", "v", "len", "threshold", F.col("s.c").alias("c"), "part", "g")
    return first.union(_met(rows.join(groups, "c").select("vec_id", "v", "len", "c", "part", "g"), sent, k))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vec_id, v, len`` for both tables; exact (see ``search``).

    Ties go to the smaller vec_id. Shorter vectors count as ending in zeros.
    Candidate rows that repeat an id rank one by one; a repeated query id is one
    query, its least vector. Fewer candidates than ``k`` give fewer rows; an empty
    table none.
    """
    found = search(vectors, queries, k).where("vec_id IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def share_verified(found: DataFrame) -> DataFrame:
    """One row ``verified, met`` of ``search``'s costs: products multiplied out, and pairs of a query and a candidate of a block it met."""
    return found.where("vec_id IS NULL").agg(F.sum("verified").alias("verified"), F.sum("met").alias("met"))


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for each whose id 100 divides."""
    vectors = scaled(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM u q JOIN u c ON q.i = c.i WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
