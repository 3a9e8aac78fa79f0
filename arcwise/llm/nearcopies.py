"""Near-duplicates by the exact Jaccard similarity of shingle sets.

SimHash finds the groups that can hold a link, and the sets of each group are
compared in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.simhash import by_group, linked_keys, majority_bits, shingle_hashes
from arcwise.llm.tables import one_row_per_id, parted, shuffle_count, small_batches
from arcwise.operators.components import star_labels
from arcwise.storage import materialize

#: A part of a large group holds about so many rows, or so many shingles, whichever is reached first.
PART_ROWS, PART_SHINGLES = 1024, 1 << 19
_U = np.uint64


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, rising."""
    return np.unique(shingle_hashes(text, words))


def minima_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` minima of a set under fixed mixings; none for the empty set.

    Two sets share the key of a band with a chance of ``J ** rows`` at a Jaccard similarity of J.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    r = np.random.default_rng(42)
    flip, odd = (r.integers(0, 1 << 64, bands * rows, np.uint64) for _ in range(2))
    odd |= _U(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024, None] ^ flip) * odd
        mixed ^= mixed >> _U(32)
        mixed *= _U(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = (key ^ column) * _U(0xBF58476D1CE4E5B9)
        key ^= key >> _U(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bits: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, digest, n, fp, keys``: digest and size of the shingle set, its SimHash, its packed keys."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            columns = [
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([majority_bits(s, bits) for s in sets], pa.binary()),
                pa.array([minima_keys(s, bands, rows).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "n", "fp", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n long, fp binary, keys binary")


def _keyed(batches):
    for batch in batches:
        raw = batch.column("keys").to_pylist()
        again = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) // 8 for k in raw]))
        keys = pa.array(np.frombuffer(b"".join(raw), np.int64))
        yield pa.RecordBatch.from_arrays([keys, batch.column("node").take(again), batch.column("fp").take(again)], ["key", "node", "fp"])


def set_forest(sets: list[np.ndarray], over: int, under: int) -> np.ndarray:
    """For each set the first that links of a similarity of ``over / under`` or more lead to.

    Each set is compared with all larger ones that its size allows and that no link has reached yet.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(codes), bool)
    root = np.array(order)
    for r in range(len(order) - 1):
        to = int(np.searchsorted(sizes, sizes[r] * under // over, "right"))
        q = r + 1 + np.flatnonzero(root[r + 1 : to] != root[r])
        if not len(q):
            continue
        own = codes[starts[r] : starts[r] + sizes[r]]
        mark[own] = True
        first = np.cumsum(sizes[q]) - sizes[q]
        at = np.arange(int(sizes[q].sum())) + np.repeat(starts[q] - first, sizes[q])
        common = np.add.reduceat(mark[codes[at]].astype(np.int64), first)
        mark[own] = False
        near = q[under * common >= over * (sizes[r] + sizes[q] - common)]
        joined = np.unique(np.append(root[near], root[r]))
        root[np.isin(root, joined)] = joined[0]
    out = np.empty(len(order), np.int64)
    out[order] = root
    return out


def linked_sets(over: int, under: int):
    """Links of the rows of whole groups by exact similarity, as a tree."""

    def compare(part: pa.Table):
        sets = [np.frombuffer(raw, np.uint64) for raw in part.column("shingles").to_pylist()]
        node = part.column("node").to_numpy()
        group = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
        root = np.arange(part.num_rows)
        for lo, hi in zip([0, *cuts], [*cuts, part.num_rows], strict=True):
            root[lo:hi] = lo + set_forest(sets[lo:hi], over, under)
        own = np.flatnonzero(root != np.arange(part.num_rows))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

    return by_group(compare)


def exact_links(docs: DataFrame, groups: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """Links ``a, b`` between rows of one group whose shingle sets have a similarity of ``over / under`` or more.

    ``groups`` has ``doc_id, n, key``. A large group is cut into parts by hash, and every two parts meet, so that
    no task holds more than two parts.
    """
    total = groups.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_n"))
    parts = F.ceil(F.greatest(F.col("_rows") / PART_ROWS, F.col("_n") / PART_SHINGLES)).cast("int")
    large = materialize(total.select("key", parts.alias("_parts")).where("_parts > 1"), "large")
    placed = groups.select("doc_id", "key").join(large, "key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    def sets(batches):
        for batch in batches:
            raw = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("key"), batch.column("_parts"), raw], ["node", "key", "_parts", "shingles"])

    found = parted(docs.select("doc_id", "text"), groups)[0].join(placed, "doc_id").withColumnRenamed("doc_id", "node").select("node", "key", "_parts", "text")
    found = found.mapInArrow(sets, "node long, key long, _parts int, shingles binary")
    found = found.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    found = found.select("key", "node", "shingles", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    met = found.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "shingles")
    met = met.repartition(shuffle_count(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return met.mapInArrow(linked_sets(over, under), "a long, b long")


def first_of_near_copies(docs: DataFrame, words: int, over: int, under: int, bits: int, radius: int, bands: int, rows: int) -> DataFrame:
    """``doc_id`` of the documents that stay: the smallest of each group.

    Texts link when their sets of shingles of ``words`` words have a Jaccard similarity of ``over / under`` or more,
    and groups are what links lead to; texts without words are one group. Candidates share a band of minima and have
    SimHash fingerprints of their sets within the radius. Groups of candidates are compared exactly, so no link is
    false, and one is lost only if both texts come into different groups of candidates. Rows without a doc_id take
    no part; of rows that repeat one, that with the least text is the document. Shingles are told apart by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    docs = one_row_per_id(docs, "doc_id", "text")
    made = materialize(sketches(docs, words, bits, bands, rows), "sketches")
    nodes = made.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "fp", "keys")).alias("_"))
    nodes = materialize(nodes.select(F.col("_.doc_id").alias("node"), "_.n", "_.fp", "_.keys"), "nodes")
    keyed = nodes.select("node", "fp", "keys").mapInArrow(_keyed, "key long, node long, fp binary")
    near = star_labels(linked_keys(keyed, keyed.select("key"), radius), "a", "b")
    groups = materialize(nodes.select(F.col("node").alias("id"), "n").join(near, "id").select(F.col("id").alias("doc_id"), "n", F.col("component").alias("key")), "groups")
    labels = star_labels(exact_links(docs, groups, words, over, under), "a", "b")
    later = labels.where("id <> component").select(F.col("id").alias("node"))
    return nodes.select("node").join(later, "node", "left_anti").withColumnRenamed("node", "doc_id")
