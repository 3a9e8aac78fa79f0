"""Removal of word runs that occur earlier, found by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ten words and probed
with every rolling run of ten words. A run of twenty words that occurs twice
holds a whole reference block at each place, and the probes find it at the other. So only windows all of
whose reference blocks are hit can repeat; windows with the
same words are put in order of document and place. All but the first go. Windows
that follow each other in a document and in the one they repeat make a maximal exact repeat.

Anchors are found by hashes, whose collisions only add windows; windows are the same if a 128-bit cryptographic digest of
their words is. Both travel in packed pieces: a unit of some megabytes of text sends each of its hashes once, in one
piece to each bucket of hashes, and gets back the places of its blocks that were hit there. So a run that a third of all
documents hold comes once for each unit, and a bucket follows the distinct hashes, not their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import one_row_per_id, parted, read, shuffle_count, small_batches
from arcwise.llm.words import find_words, in_units
from arcwise.storage import materialize

#: Words of a block; text of a unit; text for which one more bucket is made.
BLOCK, UNIT_BYTES, BUCKET_BYTES = 10, 2 << 20, 64 << 20
PIECES = "bucket int, unit long, kind int, hashes binary, places binary, ids binary, runs binary"
PLACES = "unit long, kind int, places binary, ids binary, runs binary"
WINDOWS = "bucket int, unit long, kind int, hashes binary, places binary, ids binary, runs binary, of_ids binary, of_places binary"
LATER = "unit long, places binary, ids binary, runs binary, of_ids binary, of_places binary"
RUNS = "array<struct<start: long, n_words: long, of_doc: long, of_start: long>>"
_U = np.uint64
_HIT, _UNIT, _KNOWN = 0, 2, 3


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Little-endian bytes, all lowest bytes first, which compress well when small."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(raw: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_rising(values: np.ndarray, width: int = 4) -> bytes:
    return pack(np.diff(values, prepend=0), width)


def unpack_rising(raw: bytes, width: int = 4) -> np.ndarray:
    return np.cumsum(unpack(raw, width).astype(np.int64))


def split_by(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _ids(piece: pa.RecordBatch) -> np.ndarray:
    return piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _frame(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _groups(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal keys start in ``order``, and how many each has."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(order)))


def block_pieces(buckets: int, bits: int = 64):
    """Each unit's distinct hashes of rolling runs; ``kind`` 1 marks those of reference blocks, which have their places.

    The unit's own row holds its documents. Blocks that come again in the unit are known to be hit at once. Fewer ``bits`` of
    the hashes make more of them equal, which costs time but changes no result.
    """

    def run(batches):
        unit = TaskContext.get().partitionId() << 24
        for piece, data, bounds in in_units(batches, UNIT_BYTES):
            words = find_words(data, bounds)
            at, hashes = words.windows(words.hashes(), BLOCK)
            if not len(at):
                continue
            hashes = hashes & _U((1 << bits) - 1)
            text = np.searchsorted(words.first, at, "right") - 1
            grid = (at - words.first[text]) % BLOCK == 0
            order = np.lexsort((~grid, hashes))  # blocks first
            starts, many = _groups(order, hashes)
            lead = order[starts]
            known = np.sort(at[order[np.repeat(many > 1, many) & grid[order]]])
            rows = [(unit % buckets, unit, _UNIT, b"", b"", pack(_ids(piece), 8), pack(np.diff(words.first)))]
            if len(known):
                rows.append((unit % buckets, unit, _KNOWN, b"", pack_rising(known), b"", b""))
            for kind in (0, 1):
                own = lead[grid[lead] == kind]
                own = own[np.argsort(at[own])] if kind else own
                key = (hashes[own] >> _U(32)) % _U(buckets)
                low = hashes[own] & _U(0xFFFFFFFF)
                # probes are sent in rising order of hash, which packs well
                rows += [(b, unit, kind, pack(low[i]) if kind else pack_rising(np.sort(low[i])), pack_rising(at[own[i]]) if kind else b"", b"", b"") for b, i in split_by(key, buckets)]
            yield _frame(rows, PIECES)
            unit += 1

    return run


def hit_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Places of reference blocks whose hash comes from more than one unit; unit rows and known places go on."""
    passed = group[group.kind >= _UNIT]
    rows = [(u, _UNIT if k == _UNIT else _HIT, p, i, r) for u, k, p, i, r in zip(passed.unit, passed.kind, passed.places, passed.ids, passed.runs, strict=True)]
    blocks = group[group.kind == 1]
    if len(blocks):
        hashes = [unpack(h) for h in blocks.hashes]
        known, seen = np.unique(np.concatenate(hashes), return_counts=True)
        for raw in group.hashes[group.kind == 0]:
            h = unpack_rising(raw).astype(np.uint32)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            np.add.at(seen, i[known[i] == h], 1)
        known = known[seen > 1]
        for u, h, p in zip(blocks.unit, hashes, blocks.places, strict=True):
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = unpack_rising(p)[known[i] == h]
                if len(hit):
                    rows.append((u, _HIT, pack_rising(hit), b"", b""))
    return pd.DataFrame(rows, columns=["unit", "kind", "places", "ids", "runs"])


def places_by_document(group: pd.DataFrame) -> pd.DataFrame:
    """A unit's hit blocks from all buckets, as places in its documents."""
    unit, hits = group[group.kind == _UNIT], group[group.kind == _HIT]
    rows = []
    if len(unit) and len(hits):
        first = np.concatenate([[0], np.cumsum(unpack(unit.runs.iloc[0]).astype(np.int64))])
        ids = unpack(unit.ids.iloc[0], 8).view(np.int64)
        places = np.unique(np.concatenate([unpack_rising(p) for p in hits.places]))
        cuts = np.searchsorted(places, first)
        for i in np.flatnonzero(np.diff(cuts)):
            rows.append((ids[i], pack_rising(places[cuts[i] : cuts[i + 1]] - first[i])))
    return pd.DataFrame(rows, columns=["doc_id", "places"])


def window_digests(words, at: np.ndarray, size: int) -> np.ndarray:
    """Two numbers that stand for the words of each window: a 128-bit digest of them, joined by spaces."""
    length = words.ends - words.starts
    to = np.cumsum(length + 1)
    line = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    start = to - length - 1
    spots = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
    line[spots] = words.data[np.arange(int(length.sum())) + np.repeat(words.starts - (np.cumsum(length) - length), length)]
    raw, digest = line.tobytes(), hashlib.blake2b
    spans = zip(start[at].tolist(), (to[at + size - 1] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([digest(raw[x:y], digest_size=16).digest() for x, y in spans]), np.uint64).reshape(-1, 2)


def window_pieces(buckets: int, size: int):
    """Each unit's distinct windows of hit blocks, at their first places; later places in the unit are known at once."""

    def run(batches):
        unit = TaskContext.get().partitionId() << 24
        for piece, data, bounds in in_units(batches, UNIT_BYTES):
            ids, places = _ids(piece), piece.column("places").to_pylist()
            words = find_words(data, bounds)
            text = np.repeat(np.arange(len(ids)), np.diff(words.first))
            # blocks that were not hit, and windows without one
            missed = ((np.arange(len(text)) - words.first[text]) % BLOCK == 0).astype(np.int64)
            for i, raw in enumerate(places):
                if raw:
                    missed[unpack_rising(raw) + words.first[i]] = 0
            sums = np.concatenate([[0], np.cumsum(missed)])
            at = np.flatnonzero(np.arange(len(text)) + size <= words.first[text + 1])
            at = at[sums[at + size - BLOCK + 1] == sums[at]]
            if not len(at):
                continue
            text = text[at]
            digests = window_digests(words, at, size)
            place = at - words.first[text]
            order = np.lexsort((place, ids[text], digests[:, 1], digests[:, 0]))
            starts, many = _groups(order, digests[:, 0], digests[:, 1])
            lead = order[starts]
            first = np.repeat(lead, many)
            later = first != order
            rows = []
            if later.any():
                own, of = order[later], first[later]
                by = np.argsort(own)
                own, of = own[by], of[by]
                docs, runs = np.unique(text[own], return_counts=True)
                rows.append((unit % buckets, unit, _KNOWN, b"", pack(place[own]), pack(ids[docs], 8), pack(runs), pack(ids[text[of]], 8), pack(place[of])))
            lead = np.sort(lead)
            for b, i in split_by(digests[lead, 0] % _U(buckets), buckets):
                i = lead[i]
                docs, runs = np.unique(text[i], return_counts=True)
                rows.append((b, unit, _HIT, np.ascontiguousarray(digests[i]).tobytes(), pack(place[i]), pack(ids[docs], 8), pack(runs), b"", b""))
            yield _frame(rows, WINDOWS)
            unit += 1

    return run


def later_windows(group: pd.DataFrame) -> pd.DataFrame:
    """Places of windows whose words also start earlier, each with the first place of its words."""
    known = group[group.kind == _KNOWN]
    columns = ["unit", "places", "ids", "runs", "of_ids", "of_places"]
    rows = list(known[columns].itertuples(index=False, name=None))
    group = group[group.kind == _HIT]
    if len(group):
        digests = np.concatenate([np.frombuffer(h, np.uint64).reshape(-1, 2) for h in group.hashes])
        places = [unpack(p).astype(np.int64) for p in group.places]
        ids = np.concatenate([np.repeat(unpack(i, 8).view(np.int64), unpack(r)) for i, r in zip(group.ids, group.runs, strict=True)])
        at = np.concatenate(places)
        order = np.lexsort((at, ids, digests[:, 1], digests[:, 0]))
        starts, many = _groups(order, digests[:, 0], digests[:, 1])
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[starts], many)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in places])])
        for u, lo, hi in zip(group.unit, cuts[:-1], cuts[1:], strict=True):
            own = lo + np.flatnonzero(first[lo:hi] != np.arange(lo, hi))
            if len(own):
                new = np.flatnonzero(np.append(True, ids[own][1:] != ids[own][:-1]))
                rows.append((u, pack(at[own]), pack(ids[own][new], 8), pack(np.diff(np.append(new, len(own)))), pack(ids[first[own]], 8), pack(at[first[own]])))
    return pd.DataFrame(rows, columns=columns)


def maximal_repeats(size: int):
    """A unit's later windows, joined to maximal exact repeats where both places go on by one word."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.repeat(unpack(i, 8).view(np.int64), unpack(r)) for i, r in zip(group.ids, group.runs, strict=True)])
        at, of_at = (np.concatenate([unpack(p).astype(np.int64) for p in group[c]]) for c in ("places", "of_places"))
        of = np.concatenate([unpack(i, 8).view(np.int64) for i in group.of_ids])
        order = np.lexsort((at, ids))
        ids, at, of, of_at = ids[order], at[order], of[order], of_at[order]
        new = np.ones(len(ids), bool)
        new[1:] = (np.diff(ids) != 0) | (np.diff(of) != 0) | (np.diff(at) != 1) | (np.diff(of_at) != 1)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(ids))) + size - 1
        docs, cuts = np.unique(ids[start], return_index=True)
        runs = [{"start": a, "n_words": n, "of_doc": o, "of_start": b} for a, n, o, b in zip(at[start].tolist(), length.tolist(), of[start].tolist(), of_at[start].tolist(), strict=True)]
        ends = np.append(cuts[1:], len(start))
        return pd.DataFrame({"doc_id": docs, "repeats": [runs[x:y] for x, y in zip(cuts, ends, strict=True)]})

    return run


def without_repeats(others: list[str], whole: bool):
    """Each text without the words that a repeat covers, joined by spaces; with ``whole`` texts that lose nothing as they are."""

    def run(batches):
        for batch in batches:
            words, removed, kept = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("repeats").to_pylist(), strict=True):
                text = text.as_py()
                found = (text or "").encode().split()
                words.append(len(found))
                gone = np.zeros(len(found), bool)
                for r in runs or ():
                    gone[r["start"] : r["start"] + r["n_words"]] = True
                removed.append(int(gone.sum()))
                if whole and not removed[-1]:
                    kept.append(text)
                else:
                    kept.append(b" ".join([found[i] for i in np.flatnonzero(~gone)] if removed[-1] else found).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ["doc_id", *others]), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", *others, "n_words", "n_removed", "kept"],
            )

    return run


def exact_repeats(docs: DataFrame, size: int = 20, bits: int = 64) -> DataFrame:
    """``doc_id, repeats`` of the documents (``doc_id, text``; ids whole, not null and each once) that repeat something.

    A repeat has ``start`` and ``n_words`` (``size`` or more), and ``of_doc`` and ``of_start``, where the same words start
    earlier: in a smaller doc_id, or before it in the same text. Every window of ``size`` words (19 or more) that also
    starts earlier lies in a repeat.
    """
    if size < 2 * BLOCK - 1:
        raise ValueError(f"a window needs {2 * BLOCK - 1} words to hold a block of {BLOCK}")
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_count(docs.sparkSession), -(-text_bytes // BUCKET_BYTES))
    probes = docs.select("doc_id", "text").mapInArrow(block_pieces(buckets, bits), PIECES)
    hits = probes.groupBy("bucket").applyInPandas(hit_blocks, PLACES)
    anchors = materialize(hits.groupBy("unit").applyInPandas(places_by_document, "doc_id long, places binary"), "anchors")
    # a window holds a whole block, so texts without an anchor have none that repeats and stay where they are
    around = parted(docs.select("doc_id", "text"), anchors)[0].join(anchors, "doc_id").mapInArrow(window_pieces(buckets, size), WINDOWS)
    later = around.groupBy("bucket").applyInPandas(later_windows, LATER)
    return later.groupBy("unit").applyInPandas(maximal_repeats(size), f"doc_id long, repeats {RUNS}")


def remove_repeats(docs: DataFrame, size: int = 20, whole: bool = False) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept`` in place of ``text``.

    A word goes if a window of ``size`` words (19 or more) covers it whose words
    also start earlier: in a smaller doc_id, or before it in the same text.
    ``kept`` holds the other words, joined by one space; with ``whole`` a text that loses nothing is kept as it is. Null, empty and short
    texts lose nothing; null gives an empty ``kept``, with ``whole`` null. Rows without a doc_id take no part; of
    rows that repeat one, that with the least text is the document. An empty
    table gives an empty result. Other columns are kept, but for those named ``n_words``, ``n_removed``, ``kept`` or ``repeats``.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_words", "n_removed", "kept", "repeats")]
    docs = one_row_per_id(docs, "doc_id", "text", *others)
    # a text moves to the places of its anchors and here, with the other columns, to its repeats, if it may have any
    repeats = materialize(exact_repeats(docs, size), "repeats")
    some, none = parted(docs, repeats)
    found = some.join(repeats, "doc_id", "left").union(none.withColumn("repeats", F.lit(None).cast(RUNS)))
    schema = docs.select("doc_id", *others).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return found.mapInArrow(without_repeats(others, whole), schema)


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier run of 20, over all documents."""
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
