"""Periodic runs of words: stretches that go on repeating their first words.

A text's suffixes are ordered and the common lengths of neighbours (LCP) found by doubling. Then, from the
greatest LCP down, classes of suffixes are united as Kruskal's edges are, each class an ordered list of positions. Where two
positions i < j become neighbours at an LCP of l >= j - i, the words from i to j + l have period j - i. It is their
smallest: with a smaller one a position between them would be in the class already. They end at j + l as the LCP does, so
those that can't start earlier are runs, and every run is seeded once, by its start and its start plus its period.

A run of L words has a seed with an LCP of L / 2 or more. So a text in which no window of half the least length comes
again has none, which hashes tell for many texts at once, and no class below that LCP is united.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import read, small_batches
from arcwise.llm.words import WORD_BREAKS, find_words, in_units

UNIT_BYTES = 1 << 19
RUNS = "array<struct<start: long, length: long, period: long>>"


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``ids`` in order, and the LCP of each with the one before it (0 for the first)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, size = [rank], 1
    while size < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        levels.append(rank)
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[same + 1] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def runs_of(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``least`` words or more and two periods or more, by start and period."""
    order, common = suffix_order(ids)
    edges = np.flatnonzero(common >= -(-least // 2))
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent = list(range(len(ids)))
    places = {}
    words, found = ids.tolist(), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(i: int, j: int, lcp: int) -> None:
        if j - i <= lcp and j - i + lcp >= least and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((i, j - i + lcp, j - i))

    for x, y, lcp in zip(order[edges - 1].tolist(), order[edges].tolist(), common[edges].tolist(), strict=True):
        x, y = root(x), root(y)
        large, small = places.pop(x, None) or [x], places.pop(y, None) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y] = x
        gaps = [bisect_left(large, p) for p in small]
        for k, (gap, p) in enumerate(zip(gaps, small, strict=True)):
            # of those that fall between the same two places, the first meets the one and the last the other
            if gap and (k == 0 or gaps[k - 1] != gap):
                seed(large[gap - 1], p, lcp)
            if gap < len(large) and (k + 1 == len(small) or gaps[k + 1] != gap):
                seed(p, large[gap], lcp)
        if len(small) == 1:
            large.insert(gaps[0], small[0])
        else:
            large += small
            large.sort()  # two ordered lists are merged in one pass
        places[x] = large
    return sorted((s, n, p) for s, n, p in found)


def _repeating(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and whether one of its windows of ``size`` words comes again in it, by hash (others never do)."""
    words = find_words(data, bounds)
    at, hashes = words.windows(words.hashes(), size)
    text = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((hashes, text))
    again = (np.diff(hashes[order]) == 0) & (np.diff(text[order]) == 0)
    out = np.zeros(len(bounds) - 1, bool)
    out[text[order][1:][again]] = True
    return np.diff(words.first), out


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are all stretches of ``least`` words or more (4 at least) and two smallest periods or more that no neighbouring word
    extends, by start and period; word numbers start at 0. ``collapsed`` holds the words that no run contains after its first
    period, joined by one space. Words are what spaces, tabs and line ends separate.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one, so ids may repeat or be null;
    input columns of the three names are replaced, all others kept; an empty table gives an empty result. A text is
    worked on whole, in memory of some 300 bytes a word if it repeats itself.
    """
    if least < 4:
        raise ValueError("runs need four words at least")
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]

    def run(batches):
        for piece, data, bounds in in_units(batches, UNIT_BYTES):
            count, repeats = _repeating(data, bounds, -(-least // 2))
            raw, runs, collapsed = data.tobytes(), [], []
            for k, again in enumerate(repeats.tolist()):
                words = raw[bounds[k] : bounds[k + 1]].split()
                found = []
                if again:
                    number = {}
                    found = runs_of(np.array([number.setdefault(w, len(number)) for w in words]), least)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, p in found:
                        gone[s + p] += 1
                        gone[s + n] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(b" ".join(words).decode())
            columns = [pa.array(count, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + columns, [*kept, "n_words", "runs", "collapsed"])

    empty = docs.sparkSession.createDataFrame([], f"n_words long, runs {RUNS}, collapsed string")
    schema = docs.select(*kept).schema
    for field in empty.schema:
        schema = schema.add(field)
    return docs.select(*kept).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in a tenth of the texts, by checksum of the id, all words from some place on repeat the first few from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.filter(F.split("text", WORD_BREAKS), lambda w: w != "")
    # an array of one, so that the words are bound to a name
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them with planted ones: the longest, and digests of all and of what is left."""
    done = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")), 12)
    order = lambda x, y: F.when((x.length > y.length) | ((x.length == y.length) & (x.start < y.start)), -1).when((x.length == y.length) & (x.start == y.start) & (x.period < y.period), -1).otherwise(1)
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
