"""Collocations: phrases of two to four words whose words come together more often than apart, for each language.

Counting is by vertical partitioning of the word suffixes. Every word occurrence starts a suffix, of which the first four words
count, up to the end of its piece. Suffixes are partitioned by prefixes that have at most a budget of
occurrences each: single words, and where a word is more frequent, the word with its next, and so on (each further word takes a
scan, for the frequent prefixes alone). Prefixes that follow each other are grouped up to the budget; a group's suffixes meet in one
task, which orders them, so that they are the leaves of a subtree of depth four, and sums leaf totals at its nodes. Prefixes over the budget
are the tree's top, whose counts the scans give.

A phrase is no more frequent than its words, its pairs and its triples of words. So these are first counted by slots of a hash, one for
each word of the corpus up to a bound, and suffixes end before a word, pair or triple whose slot is too rare. That drops no phrase, and less
is dropped where the corpus has many more words than there are slots. What is written or sent is packed with zstd.

Words travel as 62-bit hashes of language and word, with 0 for the end; that no two words of a counted hash are alike is checked,
and another seed taken if any are. The texts are read once and written as word numbers, which later scans read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_running_sum
from arcwise.llm.substrings import pack, pack_rising, unpack, unpack_rising
from arcwise.llm.tables import read, small_batches
from arcwise.llm.words import find_words, in_units
from arcwise.storage import forget, materialize

#: Words of the longest phrase; text of a unit; words ordered at a time; most slots (a bit each is broadcast), and slots of a block.
LONGEST, UNIT_BYTES, ORDERED, MOST_SLOTS, BLOCK_SLOTS = 4, 2 << 20, 1 << 20, 1 << 27, 1 << 16
#: Suffixes of a group (twice that at most), each of some 200 bytes in the task that orders them.
BUDGET = 1 << 20
UNKNOWN = "und"
KEYS = ["k1", "k2", "k3", "k4"]
ENCODED = "n long, vocabulary binary, ids binary, opens binary, words binary, langs array<string>, of binary"
COUNTED = "lang string, word string, key long, n long"
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*(ord(c) for c in ".,;:!?"), *range(0x0A, 0x0E)]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def encoded_units(seed: int):
    """Each unit as numbers of its words, its vocabulary, and the word and language of each entry."""

    def run(batches):
        for piece, data, bounds in in_units(batches, UNIT_BYTES):
            data = _LOWER[data]
            words = find_words(data, bounds, _BETWEEN)
            if not len(words.starts):
                continue
            langs, of_lang = np.unique(np.array(piece.column("lang").to_pylist(), object), return_inverse=True)
            salts = np.array([int.from_bytes(hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest()) for x in langs], _U)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first))
            keys = (_mixed(words.hashes() ^ salts[of_lang[text]]) >> _U(1)) | _U(1)
            vocabulary, first, ids = np.unique(keys, return_index=True, return_inverse=True)
            breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[words.starts]
            opens = np.ones(len(keys), bool)
            opens[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
            raw = data.tobytes()
            names = b" ".join([raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
            row = [vocabulary.astype("<u8").tobytes(), *(_zipped(x) for x in (pack(ids), np.packbits(opens).tobytes(), names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(keys)]), *(pa.array([x], pa.binary()) for x in row), pa.array([list(langs)], pa.list_(pa.string())), pa.array([_zipped(pack(of_lang[text[first]]))], pa.binary())],
                ["n", "vocabulary", "ids", "opens", "words", "langs", "of"],
            )

    return run


def _keys(data: bytes) -> np.ndarray:
    """Rising hashes, as ``pack_rising`` and ``_zipped`` left them."""
    return np.cumsum(unpack(_unzipped(data), 8), dtype=_U)


def _gathered(batches) -> Iterator[list[tuple]]:
    held, words = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("n", "vocabulary", "ids", "opens")), strict=True):
            held.append((row[0], np.frombuffer(row[1], "<u8"), *(_unzipped(x) for x in row[2:])))
            words += row[0]
            if words >= ORDERED:
                yield held
                held, words = [], 0
    if held:
        yield held


def _held(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Counts, of which the last array of each part has one for each row, up to ``ORDERED`` of them and a part; they then meet in the task."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[-1])
        if rows >= ORDERED:
            yield held
            held, rows = [], 0
    if held:
        yield held


class Slots:
    """Which words, pairs and triples may be frequent: packed bits for the slots of their hashes, all of them where there are none yet."""

    def __init__(self, number: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None, triples: np.ndarray | None = None):
        self.number, self.words, self.pairs, self.triples = number, words, pairs, triples

    def of_words(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _U(1)) % _U(self.number)).astype(np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mixed(a * _U(0x9E3779B97F4A7C15) + b) % _U(self.number)).astype(np.int64)

    def of_triples(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.of_pairs(_mixed(a * _U(0x9E3779B97F4A7C15) + b), c)

    @staticmethod
    def may_be(bits: np.ndarray | None, slots: np.ndarray) -> np.ndarray:
        return np.ones(len(slots), bool) if bits is None else (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def _read_units(units: list[tuple], slots: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary of some units, the place of each word in it (-1 for rare ones), and whether it goes on to the next word and the one after."""
    vocabulary = np.unique(np.concatenate([v for _, v, _, _ in units]))
    number = np.where(slots.may_be(slots.words, slots.of_words(vocabulary)), np.arange(len(vocabulary)), -1)
    ids = np.concatenate([number[np.searchsorted(vocabulary, v)][unpack(i)] for _, v, i, _ in units])
    opens = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=n).astype(bool) for n, _, _, o in units])
    goes_on = np.zeros(len(ids), bool)
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & ~opens[1:])
    goes_on[at[slots.may_be(slots.pairs, slots.of_pairs(vocabulary[ids[at]], vocabulary[ids[at + 1]]))]] = True
    goes_far = np.zeros(len(ids), bool)
    at = np.flatnonzero(goes_on[:-1] & goes_on[1:])
    goes_far[at[slots.may_be(slots.triples, slots.of_triples(*(vocabulary[ids[at + j]] for j in range(3))))]] = True
    return vocabulary, ids, goes_on, goes_far


def slot_counts(slots: Slots, size: int, least: int):
    """How often words, pairs or triples (by ``size``) of each slot come in some units, up to ``least``, in one piece for each block of slots."""

    def counted(batches):
        for units in _gathered(batches):
            vocabulary, ids, goes_on, goes_far = _read_units(units, slots)
            if size == 1:
                found = slots.of_words(vocabulary)[ids]
            else:
                at = np.flatnonzero(goes_on if size == 2 else goes_far)
                found = (slots.of_pairs if size == 2 else slots.of_triples)(*(vocabulary[ids[at + j]] for j in range(size)))
            yield np.unique(found, return_counts=True)

    def run(batches):
        for held in _held(counted(batches)):
            which, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            times = np.bincount(of, np.concatenate([x for _, x in held]), minlength=len(which)).astype(np.int64)
            cuts = np.searchsorted(which, np.arange(0, slots.number + BLOCK_SLOTS, BLOCK_SLOTS))
            times = np.minimum(times, least)
            rows = [(int(k), _zipped(pack_rising(which[cuts[k] : cuts[k + 1]] - k * BLOCK_SLOTS)), _zipped(pack(times[cuts[k] : cuts[k + 1]]))) for k in np.flatnonzero(np.diff(cuts))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "slots", "times"])

    return run


def block_bits(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK_SLOTS, np.int64)
        for which, times in zip(group.slots, group.times, strict=True):
            total[unpack_rising(_unzipped(which))] += unpack(_unzipped(times))
        return pd.DataFrame({"block": group.block[:1], "bits": [np.packbits(total >= least).tobytes()]})

    return run


def _frequent_slots(units: DataFrame, slots: Slots, size: int, least: int) -> np.ndarray:
    """A bit for each slot whose words, pairs or triples come ``least`` times or more; MOST_SLOTS bits at most come to the driver."""
    parts = units.mapInArrow(slot_counts(slots, size, least), "block int, slots binary, times binary")
    bits = np.zeros(slots.number // 8, np.uint8)
    for row in parts.groupBy("block").applyInPandas(block_bits(least), "block int, bits binary").toLocalIterator():
        bits[row.block * BLOCK_SLOTS // 8 : (row.block + 1) * BLOCK_SLOTS // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def counted_words(slots: Slots):
    """Each unit's words that may be frequent, with their counts; and under key 0 all words of each language."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, of = np.frombuffer(row["vocabulary"], "<u8"), unpack(_unzipped(row["of"]))
                n = np.bincount(unpack(_unzipped(row["ids"])), minlength=len(vocabulary))
                kept = np.flatnonzero(slots.may_be(slots.words, slots.of_words(vocabulary)))
                words, langs = _unzipped(row["words"]).split(b" "), row["langs"]
                totals = np.bincount(of, n, minlength=len(langs)).astype(np.int64)
                names = [words[k].decode() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[k] for k in of[kept]] + langs, pa.string()), pa.array(names + [None] * len(langs), pa.string()), pa.array(np.append(vocabulary[kept].astype(np.int64), [0] * len(langs)), pa.int64()), pa.array(np.append(n[kept], totals), pa.int64())],
                    ["lang", "word", "key", "n"],
                )

    return run


def _suffixes(units: list[tuple], slots: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary of some units, their distinct suffixes of two words or more in order, as two numbers each, and how often each comes.

    A word is twice its place in the vocabulary, from 2 on, so that odd numbers are left for words that fall between; 0 is the end.
    Suffixes end before words, pairs and triples that are surely too rare.
    """
    vocabulary, ids, goes_on, goes_far = _read_units(units, slots)
    n, number = len(ids), 2 * ids + 2
    inside, columns = np.ones(n, bool), [number]
    for j in range(1, LONGEST):
        inside = inside[: max(n - j, 0)] & (goes_on[: n - 1] if j == 1 else goes_far[j - 2 : n - 2])
        column = np.zeros(n, np.int64)
        column[: len(inside)][inside] = number[j:][inside]
        columns.append(column)
    kept = columns[1] > 0
    high, low = ((a[kept] << 32 | b[kept]) for a, b in (columns[:2], columns[2:]))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
    start = np.flatnonzero(new)
    return vocabulary, high[start], low[start], np.diff(np.append(start, len(high)))


def _task_suffixes(batches, slots: Slots) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_suffixes`` says of the units of a task, as far as ``_held`` goes, so that each of their suffixes is sent once."""

    def used():
        for units in _gathered(batches):
            vocabulary, high, low, times = _suffixes(units, slots)
            numbers, at = np.unique(np.concatenate([high >> 33, (high & 0xFFFFFFFF) >> 1, low >> 33, (low & 0xFFFFFFFF) >> 1, [0]]), return_inverse=True)
            yield vocabulary[numbers[1:] - 1], at[:-1].reshape(LONGEST, -1).astype(np.int32), times

    for held in _held(used()):
        vocabulary = np.unique(np.concatenate([v for v, _, _ in held]))
        a, b, c, d = np.concatenate([np.append(0, 2 * np.searchsorted(vocabulary, v) + 2)[at] for v, at, _ in held], 1)
        high, low, times = a << 32 | b, c << 32 | d, np.concatenate([t for _, _, t in held])
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        start = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)])
        yield vocabulary, high[start], low[start], np.add.reduceat(times[order], start) if len(start) else times


def _places(prefixes: np.ndarray, vocabulary: np.ndarray, high: np.ndarray, low: np.ndarray, after: int = 0) -> np.ndarray:
    """How many suffixes come before each prefix (rows of four hashes, 0 where it is shorter); with ``after`` words, before the first
    suffix past all that share these."""
    if not len(vocabulary) or not len(prefixes):
        return np.zeros(len(prefixes), np.int64)
    at = np.searchsorted(vocabulary, prefixes)
    known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == prefixes
    number = np.where(prefixes == 0, 0, np.where(known, 2 * at + 2, 2 * at + 1)).astype(np.int64)
    if after:
        number[:, after - 1] += 1
        known[:, after - 1] = False
    gone = np.zeros(len(prefixes), bool)  # behind a word between two others nothing counts
    for j in range(LONGEST):
        number[gone, j] = 0
        gone |= ~known[:, j] & (prefixes[:, j] != 0)
    x, y = number[:, 0] << 32 | number[:, 1], number[:, 2] << 32 | number[:, 3]
    left, right = np.searchsorted(high, x, "left"), np.searchsorted(high, x, "right")
    for i in np.flatnonzero((left < right) & (y > 0)):
        left[i] += np.searchsorted(low[left[i] : right[i]], y[i], "left")
    return left


def _hashes(vocabulary: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    numbers = np.stack([high >> 32, high & 0xFFFFFFFF, low >> 32, low & 0xFFFFFFFF], 1)
    return np.append(np.zeros(1, _U), vocabulary)[numbers >> 1]


def longer_prefixes(hot: np.ndarray, words: int, slots: Slots):
    """Counts of the prefixes of ``words`` words that go on from the prefixes ``hot`` of one word less; an end counts as a word."""

    def run(batches):
        for vocabulary, high, low, times in _task_suffixes(batches, slots):
            a = _places(hot, vocabulary, high, low)
            b = _places(hot, vocabulary, high, low, words - 1)
            own = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)]).astype(np.int64)
            if not len(own):
                continue
            keys = _hashes(vocabulary, high[own], low[own])
            keys[:, words:] = 0
            start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            sums = np.add.reduceat(times[own], start)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[start, j].astype(np.int64)) for j in range(LONGEST)), pa.array(sums)], [*KEYS, "f"])

    return run


def grouped_suffixes(cuts: np.ndarray, leaves: np.ndarray, slots: Slots):
    """Distinct suffixes with their counts, in one piece for each group between two cuts; leaves of the tree's top stay away."""

    def run(batches):
        for vocabulary, high, low, times in _task_suffixes(batches, slots):
            if len(leaves):
                at = _places(leaves, vocabulary, high, low)
                end = _places(leaves, vocabulary, high, low, LONGEST)
                at = at[end > at]
                high, low, times = (np.delete(x, at) for x in (high, low, times))
            bounds = np.append(_places(cuts, vocabulary, high, low), len(high))
            bounds[0] = 0
            rows = []
            for g in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[g], bounds[g + 1])
                numbers = np.stack([high[own] >> 33, (high[own] & 0xFFFFFFFF) >> 1, low[own] >> 33, (low[own] & 0xFFFFFFFF) >> 1])
                used, ids = np.unique(numbers, return_inverse=True)
                used, ids = (used[1:], ids) if used[0] == 0 else (used, ids + 1)
                rows.append((int(g), *(_zipped(x) for x in (pack_rising(vocabulary[used - 1].view(np.int64), 8), pack(ids.ravel()), pack(times[own])))))
            if rows:
                names = ["grp", "vocabulary", "ids", "times"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    return run


def subtree_counts(least: int):
    """Nodes of a group's subtree at depth two and more that have ``least`` occurrences."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_keys(v) for v in group.vocabulary]
        vocabulary = np.unique(np.concatenate(parts))
        columns = []
        for part, raw in zip(parts, group.ids, strict=True):
            number = np.append(0, np.searchsorted(vocabulary, part) + 1).astype(np.int32)
            columns.append(number[unpack(_unzipped(raw))].reshape(LONGEST, -1))
        numbers = np.concatenate(columns, 1)
        times = np.concatenate([unpack(_unzipped(t)).astype(np.int64) for t in group.times])
        columns.clear()
        high, low = (a.astype(np.int64) << 32 | b for a, b in (numbers[:2], numbers[2:]))
        order = np.lexsort((low, high))
        del high, low
        numbers, times = numbers[:, order], times[order]
        new, found = np.zeros(len(times), bool), []
        new[:1] = True
        keys = np.append(np.zeros(1, _U), vocabulary)
        for depth in range(LONGEST):
            new[1:] |= numbers[depth, 1:] != numbers[depth, :-1]
            if depth:
                start = np.flatnonzero(new)
                total = np.add.reduceat(times, start)
                start, total = (x[(total >= least) & (numbers[depth, start] > 0)] for x in (start, total))
                nodes = keys[numbers[:, start]].astype(np.int64)
                nodes[depth + 1 :] = 0
                found.append(np.vstack([nodes, total]))
        return pd.DataFrame(np.concatenate(found, 1).T, columns=[*KEYS, "f"])

    return run


def _rows(df: DataFrame) -> np.ndarray:
    table = df.select(*KEYS).toPandas()
    return np.ascontiguousarray(table.sort_values(KEYS).to_numpy(np.int64).reshape(-1, LONGEST)).view(_U)


def phrase_counts(docs: DataFrame, least: int, budget: int = BUDGET, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, phrases and hot phrases of ``lang, text``.

    The words have ``lang, word, key, f``: those of ``least`` occurrences or more, and under key 0 the number of all words of each language; the phrases ``k1`` to ``k4`` (keys of their words, 0 where they are
    shorter) and ``f``, all of two to four words with ``least`` occurrences or more; the hot ones are words and phrases of more than
    ``budget`` occurrences, of which there are at most four times the occurrences over the budget.
    """
    spark = docs.sparkSession
    small_batches(spark)
    zero = F.lit(0).cast("long")
    while True:
        coded = materialize(docs.mapInArrow(encoded_units(seed), ENCODED), "coded")
        units = coded.select("n", "vocabulary", "ids", "opens")
        size = units.agg(F.sum("n")).first()[0] or 0
        slots = Slots(min(MOST_SLOTS, max(BLOCK_SLOTS, 1 << int(size).bit_length())))
        slots.words = _frequent_slots(units, slots, 1, least)
        summed = coded.select("vocabulary", "ids", "words", "langs", "of").mapInArrow(counted_words(slots), COUNTED).groupBy("lang", "word", "key").agg(F.sum("n").alias("f"))
        words = materialize(summed, "words")
        if words.where("key <> 0").groupBy("key").count().where("count > 1").isEmpty():
            break
        forget(coded, words)
        seed += 1
    words = words.where((F.col("f") >= least) | (F.col("key") == 0))
    slots.pairs = _frequent_slots(units, slots, 2, least)
    slots.triples = _frequent_slots(units, slots, 3, least)
    level = words.where("key <> 0").select(F.col("key").alias("k1"), *(zero.alias(k) for k in KEYS[1:]), "f")
    items, tops, leaves = [], [], [np.zeros((0, LONGEST), _U)]
    for depth in range(1, LONGEST + 1):
        # prefixes over the budget: at most the number of words over the budget
        over = level.where(F.col("f") > budget)
        items.append(level.where(F.col("f") <= budget))
        tops.append(over.where(F.col(KEYS[depth - 1]) != 0))
        ends = over if depth == LONGEST else over.where(F.col(KEYS[depth - 1]) == 0)
        leaves.append(_rows(ends))
        hot = _rows(over.where(F.col(KEYS[depth - 1]) != 0))
        if depth == LONGEST or not len(hot):
            break
        more = units.mapInArrow(longer_prefixes(hot, depth + 1, slots), "k1 long, k2 long, k3 long, k4 long, f long")
        level = materialize(more.groupBy(*KEYS).agg(F.sum("f").alias("f")), "level")
    hot = materialize(reduce(DataFrame.union, tops), "hot")
    summed = with_running_sum(reduce(DataFrame.union, items), [F.col(k) for k in KEYS], F.col("f"))
    first = summed.groupBy(F.expr(f"(total - f) div {budget}").alias("grp")).agg(F.min(F.struct(*KEYS)).alias("first"))
    # one row for each group
    cuts = _rows(first.select("first.*"))
    pieces = units.mapInArrow(grouped_suffixes(cuts, np.concatenate(leaves), slots), "grp int, vocabulary binary, ids binary, times binary")
    nodes = pieces.groupBy("grp").applyInPandas(subtree_counts(least), "k1 long, k2 long, k3 long, k4 long, f long")
    # nodes of the top are cut in parts by groups; their counts are known
    below = nodes.join(F.broadcast(hot.select(*KEYS)), KEYS, "left_anti").select(*KEYS, "f")
    phrases = materialize(below.union(hot.where((F.col("k2") != 0) & (F.col("f") >= least))), "phrases")
    forget(coded)
    return words, phrases, hot


def _parts(phrases: DataFrame) -> DataFrame:
    """``slot, p1, p2, p3`` and the phrase for each of its proper prefixes (slots 1 to 3, by words) and what is left (4 to 6)."""
    zero, k = F.lit(0).cast("long"), [F.col(x) for x in KEYS]
    size = F.when(k[3] != 0, 4).when(k[2] != 0, 3).otherwise(2)
    found = []
    for cut in range(1, LONGEST):
        left = [*k[:cut], *[zero] * (3 - cut)]
        right = [*k[cut:], *[zero] * 3][:3]
        for slot, part in ((cut, left), (cut + 3, right)):
            found.append(F.when(size > cut, F.struct(F.lit(slot).alias("slot"), *(c.alias(f"p{i + 1}") for i, c in enumerate(part)))))
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return phrases.select(*KEYS, F.explode(listed).alias("part")).select(*KEYS, "part.*")


def _inner(phrases: DataFrame) -> DataFrame:
    """The phrases of two and three words inside each longer one, with the longer one's ``f``."""
    zero, k = F.lit(0).cast("long"), [F.col(x) for x in KEYS]
    spans = [(0, 2, 3), (1, 2, 3), (0, 2, 4), (1, 2, 4), (2, 2, 4), (0, 3, 4), (1, 3, 4)]
    size = F.when(k[3] != 0, 4).when(k[2] != 0, 3).otherwise(2)
    found = [F.when(size == whole, F.struct(*(c.alias(x) for c, x in zip([*k[at : at + n], *[zero] * (4 - n)], KEYS, strict=True)))) for at, n, whole in spans]
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return phrases.select("f", F.explode(listed).alias("inner")).select("inner.*", F.lit(7).alias("slot"), "f")


def scored_phrases(words: DataFrame, phrases: DataFrame, hot: DataFrame, share: int) -> DataFrame:
    """``k1`` to ``k4, a, l, r, score`` of the phrases that no longer one with ``share`` percent of their occurrences holds.

    A part's count is looked up among the hot ones, which are broadcast, and else by a join, in which a part that is not hot has at
    most three times the budget over ``least`` rows.
    """
    zero = F.lit(0).cast("long")
    columns = ["p1", "p2", "p3"]
    known = words.where("key <> 0").select(F.col("key").alias("p1"), zero.alias("p2"), zero.alias("p3"), "f")
    known = known.union(phrases.where("k4 = 0").select("k1", "k2", "k3", "f"))
    top = hot.where("k4 = 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("k3").alias("p3"), F.col("f").alias("top"))
    parts = _parts(phrases).join(F.broadcast(top), columns, "left")
    looked = parts.where("top IS NULL").drop("top").join(known, columns).select(*KEYS, "slot", "f")
    rows = looked.union(parts.where("top IS NOT NULL").select(*KEYS, "slot", "top")).union(_inner(phrases)).union(phrases.select(*KEYS, F.lit(0), "f"))
    named = {"a": 0, "l1": 1, "l2": 2, "l3": 3, "r1": 4, "r2": 5, "r3": 6, "longer": 7}
    wide = rows.groupBy(*KEYS).agg(*(F.max(F.when(F.col("slot") == slot, F.col("f"))).alias(name) for name, slot in named.items()))
    kept = wide.where(f"longer IS NULL OR longer * 100 < a * {share}")
    # 2,000,000 a passes 64 bits, so the product is a decimal of 38 digits; the quotient is a long
    for cut in (1, 2, 3):
        kept = kept.withColumn(f"s{cut}", F.expr(f"CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l{cut} AS DECIMAL(20,0)) + CAST(r{cut} AS DECIMAL(20,0)))"))
    score = F.least("s1", "s2", "s3")
    chosen = lambda side: F.when(F.col("s1") == score, F.col(f"{side}1")).when(F.col("s2") == score, F.col(f"{side}2")).otherwise(F.col(f"{side}3"))
    return kept.select(*KEYS, "a", chosen("l").alias("l"), chosen("r").alias("r"), score.alias("score"))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    Texts (``lang, text``) are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and at spaces and tabs into words. A phrase has two to
    four words of a piece and ``a`` occurrences, ``least`` or more, overlapping ones too. Each cut in two parts of ``l`` and ``r`` occurrences
    scores floor(2000000 a / (l + r)); the lowest counts, of equal ones that of the shortest first part. Phrases inside a longer
    one with ``share`` percent of their occurrences or more are dropped, whether it is or not. Ranks are by
    score and a, both falling, and phrase by bytes. ``n`` counts the language's words.

    A null language is ``und``, a null text empty. Rows may repeat and all count; other columns are ignored; an empty table
    gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words, phrases, hot = phrase_counts(texts, least, budget)
    scored = scored_phrases(words, phrases, hot, share)
    named = words.where("key <> 0")
    # the language comes with the first word, of hot words by a broadcast
    first = named.select(F.col("key").alias("k1"), "lang")
    few = F.broadcast(first.join(F.broadcast(hot.where("k2 = 0").select("k1")), "k1", "left_semi"))
    scored = scored.join(few, "k1", "left")
    scored = scored.where("lang IS NOT NULL").union(scored.where("lang IS NULL").drop("lang").join(first, "k1").select(*scored.columns))
    high = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = materialize(scored.withColumn("near", F.rank().over(high)).where(F.col("near") <= top).drop("near"), "best")
    spelled = best
    for i, k in enumerate(KEYS):
        spelled = spelled.join(named.select(F.col("key").alias(k), F.col("word").alias(f"w{i}")), k, "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(LONGEST))))
    ranked = spelled.withColumn("rank", F.row_number().over(high.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    totals = words.where("key = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations over all documents."""
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), spread AS (
    SELECT lang, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3, words[i + 3] AS w4 FROM starts
), counts AS (
    SELECT lang, [w1] AS g, count(*) AS f FROM spread GROUP BY lang, w1 HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2], count(*) FROM spread WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM spread WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM spread WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30
), named AS (
    SELECT lang, g, array_to_string(g, ' ') AS phrase, f FROM counts
), totals AS (
    SELECT lang, count(*) AS n FROM spread GROUP BY lang
), halves AS (
    SELECT lang, phrase, f AS a, k, array_to_string(g[1:k], ' ') AS one, array_to_string(g[k + 1:], ' ') AS other
    FROM (SELECT *, unnest(range(1, len(g))) AS k FROM named)
), cuts AS (
    SELECT h.lang, h.phrase, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS s
    FROM halves h JOIN named x ON x.lang = h.lang AND x.phrase = h.one JOIN named y ON y.lang = h.lang AND y.phrase = h.other
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY s, k) = 1
), inner_parts AS (
    SELECT lang, f, array_to_string(g[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM named WHERE len(g) > 2))
), longer AS (
    SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY lang, phrase
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, s::BIGINT AS score
    FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
