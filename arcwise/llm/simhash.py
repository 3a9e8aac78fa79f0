"""SimHash near-duplicates, compared bit by bit over many pairs at once."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import one_row_per_id, read, shuffle_count, small_batches
from arcwise.operators.components import star_labels
from arcwise.storage import materialize

#: Seed of the shingle hash; rows of a part of a crowded key; lanes at a time; lanes of a block; planes between two looks at it.
SEED, CROWD, PAIRS, LANES, PLANES = 42, 2048, 1 << 17, 64, 8
_U = np.uint64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased, repeats included.

    A shorter text counts as one shingle; one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes: np.ndarray, bits: int) -> bytes:
    """The bits set in over half the hashes, highest first; all zero for none.

    Past the 64 bits of a hash, each further word of the fingerprint votes over
    a fixed mixing of the same hashes.
    """
    votes = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 8192):
        h = hashes[at : at + 8192]
        for w in range(bits // 64):
            own = h
            if w:
                own = (h ^ (h >> _U(33))) * _U(0x9E3779B97F4A7C15 + 2 * w * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                own = (own ^ (own >> _U(29))) * _U(0xBF58476D1CE4E5B9)
                own = own ^ (own >> _U(32))
            votes[64 * w : 64 * w + 64] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``doc_id, fp`` of ``doc_id, text``; null texts have no words."""

    def run(batches):
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t.as_py(), words), bits) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary")


def block_keys(bits: int, radius: int, agree: int = 2):
    """Keys of which two fingerprints within the radius share at least one.

    The bits are cut into ``radius + agree`` blocks; differing bits touch
    ``radius`` blocks at most, so ``agree`` blocks are equal.
    """
    cuts = np.linspace(0, bits, radius + agree + 1).astype(int)
    groups = list(combinations(range(radius + agree), agree))
    longest = agree * int(np.diff(cuts).max())
    if longest > 48:
        raise ValueError(f"keys of {longest} bits are too long; raise the radius or lower agree")

    def keys(bit_rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bit_rows), len(groups)), np.int64)
        for g, blocks in enumerate(groups):
            key = np.full(len(bit_rows), g, np.int64)
            for b in blocks:
                for c in range(cuts[b], cuts[b + 1]):
                    key = key << 1 | bit_rows[:, c]
            out[:, g] = key
        return out

    return keys


def band_keys(bits: int, width: int):
    """Keys of consecutive bands of ``width`` bits."""

    def keys(bit_rows: np.ndarray) -> np.ndarray:
        bands = bits // width
        powers = 1 << np.arange(width, dtype=np.int64)
        values = bit_rows[:, : bands * width].reshape(-1, bands, width).astype(np.int64) @ powers
        return values + (np.arange(bands, dtype=np.int64) << width)

    return keys


def carry_save_count(planes: np.ndarray) -> list[np.ndarray]:
    """Planes of the binary digits of each lane's count, from planes of its bits."""
    digits = []
    while len(planes):
        carries = []
        while len(planes) > 1:
            if len(planes) == 2:
                planes, carry = (planes[:1] ^ planes[1:]), planes[:1] & planes[1:]
                carries.append(carry)
                break
            m = len(planes) // 3
            a, b, c, rest = planes[:m], planes[m : 2 * m], planes[2 * m : 3 * m], planes[3 * m :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            planes = np.concatenate([half ^ c, rest])
        digits.append(planes[0])
        planes = np.concatenate(carries) if carries else planes[:0]
    return digits


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """One row for each bit of the fingerprints (rows of bytes), with that bit of all of them."""
    return np.ascontiguousarray(np.unpackbits(fps, axis=1).T)


def add_digits(total: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
    """The digits of two bit-sliced numbers' sum."""
    out, carry = [], None
    for k in range(max(len(total), len(more))):
        parts = [d[k] for d in (total, more) if k < len(d)] + ([carry] if carry is not None else [])
        digits = carry_save_count(np.stack(parts))
        out.append(digits[0])
        carry = digits[1] if len(digits) > 1 else None
    return out if carry is None else [*out, carry]


def above(digits: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose bit-sliced number is over ``limit``, as bits."""
    over, same = np.zeros_like(digits[0]), np.full_like(digits[0], 0xFF)
    for k in range(max(len(digits), limit.bit_length()) - 1, -1, -1):
        digit = digits[k] if k < len(digits) else np.zeros_like(over)
        if limit >> k & 1:
            same &= digit
        else:
            over |= same & digit
            same &= ~digit
    return over


def within_radius(planes: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int, read: list | None = None) -> np.ndarray:
    """Which of the pairs (p, q) of fingerprints differ in ``radius`` bits at most, from their bit planes.

    A lane is a pair, and a block LANES lanes. Differing bits are counted plane by plane in bit-sliced counters; a
    block all of whose lanes are past the radius is abandoned, and the others go on. ``read`` gets the lanes that each
    step reads.
    """
    n = len(p)
    live = np.arange(-(-n // LANES) * LANES)
    spare = live >= n
    p, q = np.append(p, np.zeros(spare.sum(), np.int64)), np.append(q, np.zeros(spare.sum(), np.int64))
    over, digits = np.packbits(spare), [np.zeros(len(live) // 8, np.uint8)]
    for at in range(0, len(planes), PLANES):
        if not len(live):
            break
        if read is not None:
            read.append(len(live))
        here = planes[at : at + PLANES]
        differ = np.packbits(here[:, p] ^ here[:, q], axis=1)
        digits = add_digits(digits, carry_save_count(differ))
        over = np.packbits(live >= n) | above(digits, radius)
        open_blocks = (over.reshape(-1, LANES // 8) != 0xFF).any(1)
        if not open_blocks.all():
            live, p, q = (x.reshape(-1, LANES)[open_blocks].ravel() for x in (live, p, q))
            digits, over = [d.reshape(-1, LANES // 8)[open_blocks].ravel() for d in digits], over.reshape(-1, LANES // 8)[open_blocks].ravel()
    return live[np.unpackbits(over)[: len(live)] == 0]


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n rows the first row that the links lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        np.minimum.at(root, before[p], low)
        np.minimum.at(root, before[q], low)
        root = root[root]
        if (root == before).all():
            return root


def by_group(compare):
    """Hand tables of whole groups to ``compare``, from rows that lie together by ``key, i, j``."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ends = [held.column(c).combine_chunks() for c in ("key", "i", "j")]
            other = np.zeros(held.num_rows, bool)
            for c in ends:
                values = c.to_numpy()
                other |= values != values[-1]
            if other.any():
                cut = int(np.flatnonzero(other)[-1]) + 1
                yield compare(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held)

    return run


def linked_rows(radius: int):
    """Links of rows that lie together by group; each leads to its group's first."""

    def compare(part: pa.Table):
        planes = bit_planes(np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, -1))
        node = part.column("node").to_numpy()
        group = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        new = np.ones(part.num_rows, bool)
        new[1:] = (group[:, 1:] != group[:, :-1]).any(0)
        start = np.flatnonzero(new)
        last = np.repeat(np.append(start[1:], part.num_rows), np.diff(np.append(start, part.num_rows)))
        after = last - np.arange(part.num_rows) - 1  # later rows of the same group
        done, ps, qs = 0, [], []
        total = np.cumsum(after)
        while done < part.num_rows:
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            many = after[done:to]
            p = np.repeat(np.arange(done, to), many)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
            hit = within_radius(planes, p, q, radius)
            ps.append(p[hit])
            qs.append(q[hit])
            done = to
        p, q = np.concatenate(ps), np.concatenate(qs)
        root = forest(part.num_rows, p, q)
        own = np.flatnonzero(root != np.arange(part.num_rows))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

    return by_group(compare)


def linked_fingerprints(nodes: DataFrame, bits: int, radius: int, keys) -> DataFrame:
    """Links ``a, b`` between rows of ``fp, node`` that share a key and lie within the radius.

    A key with a crowd of fingerprints is cut into parts by hash, and every two
    parts meet in a group of their own, so no group grows with the crowd. A group
    returns a tree over its linked rows, never all pairs.
    """

    def keyed(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8)
            if not len(fps):
                continue
            found = keys(np.unpackbits(fps.reshape(batch.num_rows, -1), axis=1))
            again = np.repeat(np.arange(batch.num_rows), found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel()), batch.column("node").take(pa.array(again)), batch.column("fp").take(pa.array(again))], ["key", "node", "fp"]
            )

    return linked_keys(nodes.mapInArrow(keyed, "key long, node long, fp binary"), nodes.mapInArrow(keyed, "key long, node long, fp binary").select("key"), radius)


def linked_keys(rows: DataFrame, only_keys: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between rows of ``key, node, fp`` with one key that lie within the radius; ``only_keys`` has their keys."""
    # keys with more rows than a part holds: few, and known by partial counts
    crowded = materialize(only_keys.groupBy("key").count().where(F.col("count") > CROWD), "crowded")
    met = rows.join(crowded, "key", "left")
    parts = F.ceil(F.coalesce("count", F.lit(1)) / CROWD).cast("int")
    met = met.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    met = met.select("key", "node", "fp", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    met = met.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "fp")
    grouped = met.repartition(shuffle_count(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return grouped.mapInArrow(linked_rows(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int, bits: int, radius: int, keys=None) -> DataFrame:
    """``doc_id, fp, component_id`` of ``doc_id, text``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is
    the smallest doc_id that links lead to. Without ``keys`` every such link is
    found; with keys of bands, those that share a band. Null texts and texts
    without words have the fingerprint zero and link as any other. Rows without a
    doc_id take no part; of rows that repeat one, that with the least text is the
    document. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = one_row_per_id(docs, "doc_id", "text")
    fps = materialize(fingerprints(docs, words, bits), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    links = linked_fingerprints(nodes, bits, radius, keys or block_keys(bits, radius))
    labels = star_labels(links, "a", "b").withColumnRenamed("id", "node")
    known = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(materialize(known, "components"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by SimHash of 3-word shingles, linked at 3 differing bits."""
    found = near_duplicates(read(spark, sf_dir, "documents"), words=3, bits=64, radius=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
