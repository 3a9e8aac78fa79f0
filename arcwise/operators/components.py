"""Connected components by contraction to the smallest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.storage import forget, materialize


def pieces(batches: Iterator[pa.RecordBatch], columns: list[str], size: int, key: str | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Columns of longs in pieces of some ``size`` rows; rows that follow each other with one ``key`` stay together."""
    held, rows = [], 0
    for batch in batches:
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in [*columns, *([key] if key else [])]})
        rows += len(batch)
        if rows >= size:
            whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            turns = np.flatnonzero(whole[key][1:] != whole[key][:-1]) if key else [rows - 1]
            cut = int(turns[-1]) + 1 if len(turns) else 0
            if cut:
                yield {c: whole[c][:cut] for c in columns}
            held, rows = [{c: v[cut:] for c, v in whole.items()}], rows - cut
    if rows:
        yield {c: np.concatenate([h[c] for h in held]) for c in columns}


def roots_of(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least number in the component of each number below ``n``, by pairs ``x, y``."""
    top = np.arange(n)
    while True:
        a, b = top[x], top[y]
        apart = a != b
        if not apart.any():
            return top
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while True:
            far = top[top]
            if np.array_equal(far, top):
                break
            top = far


def _contracted(links: DataFrame, size: int = 250_000) -> DataFrame:
    """Pairs ``a, b`` of longs with the same components: in each ``size`` rows as they lie, a vertex and the least one it is joined to."""

    def run(batches):
        for piece in pieces(batches, ["a", "b"], size):
            ids, inverse = np.unique(np.concatenate([piece["a"], piece["b"]]), return_inverse=True)
            root = roots_of(inverse[: len(piece["a"])], inverse[len(piece["a"]) :], len(ids))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            for k in range(0, len(moved), 50_000):
                at = moved[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _tops(picks: DataFrame, max_rounds: int) -> DataFrame:
    """``id, top`` from ``id, m`` with ``m < id``: where the pointers end, which double until all are there."""
    state = picks.select("id", F.col("m").alias("top"))
    for _ in range(max_rounds):
        far = state.select(F.col("id").alias("top"), F.col("top").alias("further"))
        moved = materialize(state.join(far, "top", "left").select("id", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")), "tops")
        forget(state)
        state = moved
        if state.where("moved").isEmpty():
            return state
    raise RuntimeError(f"pointers did not end in {max_rounds} rounds")


def star_labels(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(id, component)`` for every vertex that an edge touches.

    The component is the smallest id that can be reached. In each round every vertex that has a smaller neighbour points
    at the smallest one, pointers are followed to their ends, and edges are carried over to these; those within one
    end are dropped, so that a round holds half of the vertices of the one before at most, and far fewer where
    vertices have many neighbours. Minima are partial aggregates and are written before they are joined back, so that
    adaptive execution can split the rows of a hub. Edges between longs are first contracted as they lie in a task, so that
    components whose edges lie together take one round; a vertex with one link has it inside and is not joined again.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    long = all(kind == "bigint" for _, kind in links.dtypes)
    links = materialize(_contracted(links) if long else links.distinct(), "links")
    rounds = []
    for _ in range(max_rounds):
        # a vertex without a smaller neighbour is an end of pointers
        picks = materialize(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.max("b").alias("most")), "least")
        if picks.isEmpty():
            break
        many = picks.where("m <> most").select(F.col("id").alias("a"), "m")
        picks = picks.select("id", "m")
        inner = picks.select("m").distinct().join(picks.select(F.col("id").alias("m")), "m", "left_semi")
        tops = _tops(picks, max_rounds) if not inner.isEmpty() else picks.select("id", F.col("m").alias("top"))
        rounds.append(tops.select("id", "top"))
        if many.isEmpty():
            break
        up = lambda end: tops.select(F.col("id").alias(end), F.col("top").alias(f"{end}2"))
        met = links.join(many, "a").where("b <> m").select("a", "b").join(up("a"), "a").join(up("b"), "b", "left").select(F.col("a2").alias("x"), F.coalesce("b2", "b").alias("y")).where("x <> y")
        old, links = links, materialize(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        forget(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # a round's ends are the next round's vertices, so labels are read off from the last round back
    labels = rounds[-1].select("id", F.col("top").alias("component"))
    for tops in reversed(rounds[:-1]):
        later = labels.select(F.col("id").alias("top"), "component")
        labels = labels.union(tops.join(later, "top", "left").select("id", F.coalesce("component", "top").alias("component")))
        labels = materialize(labels, "labels")
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    return labels.union(roots)
