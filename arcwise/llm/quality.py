"""Quality scores by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import read, small_batches
from arcwise.llm.words import find_words, in_units

#: Bounds of the training sample: trusted positives and unlabelled texts; buckets for byte trigrams, and as many for words; what divides
#: the weight of these.
POSITIVES, UNLABELLED, BUCKETS, DAMPED = 10_000, 10_000, 64, 4
UNIT_BYTES = 1 << 19

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 sign, 6 past ASCII, 7 space, 8 line end
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 4
_CLASS[[ord(c) for c in "|#$%&*@^~<>{}[]\\/+=_!()`"]] = 5
_CLASS[0x80:] = 6
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 7
_CLASS[0x0A] = 8
SURFACE = 28
N_FEATURES = SURFACE + 2 * BUCKETS


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of numbers for each text between consecutive ``bounds`` of ``data``.

    Shares of byte classes, sizes of words and lines, shares of words that come
    again in the text or right after themselves, and shares of words that are
    upper-case, end in a sign, or stand alone as one; then hashed byte trigrams and words.
    """
    n = len(bounds) - 1
    out = np.zeros((n, N_FEATURES))
    text = np.repeat(np.arange(n), np.diff(bounds))
    classes = np.bincount(text * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    size = np.maximum(np.diff(bounds), 1)
    out[:, 0] = np.log1p(np.diff(bounds))
    out[:, 1:10] = classes / size[:, None]
    words = find_words(data, bounds)
    hashes, length = words.hashes(), words.ends - words.starts
    count = np.diff(words.first)
    many = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)

    def mean(values):
        return np.bincount(of, values, minlength=n) / many

    out[:, 10] = np.log1p(count)
    out[:, 11] = mean(length)
    out[:, 12] = np.sqrt(np.maximum(mean(length.astype(float) ** 2) - out[:, 11] ** 2, 0))
    out[:, 13], out[:, 14] = mean(length <= 3), mean(length > 15)
    first, final = data[words.starts], data[words.ends - 1]
    out[:, 15] = mean(_CLASS[first] == 2)
    out[:, 16] = mean(_CLASS[final] == 5)
    out[:, 17] = mean(_CLASS[final] == 4)
    out[:, 18] = mean((length == 1) & (_CLASS[first] == 5))
    sums = np.concatenate([[0], np.cumsum(_CLASS[data] == 2)])
    shout = (sums[words.ends] - sums[words.starts]) * 2 > length
    out[:, 19] = mean(shout & (length > 1))
    out[:, 20] = mean(_CLASS[first] == 3)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out[:, 21] = mean(again)
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    out[:, 22] = distinct / many
    out[:, 23] = np.log1p(distinct) / np.maximum(np.log1p(count), 1)
    runs = np.diff(np.append(np.flatnonzero(new), len(hashes))) if len(hashes) else np.zeros(0)
    top = np.zeros(n)
    np.maximum.at(top, of[order][new], runs)
    out[:, 24] = top / many
    lines = classes[:, 8] + 1
    out[:, 25], out[:, 26] = np.log1p(lines), np.log1p(count / lines)
    at, pairs = words.windows(hashes, 3)
    where = of[at]
    by = np.lexsort((pairs, where))
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[by][1:] != pairs[by][:-1]) | (where[by][1:] != where[by][:-1])
    out[:, 27] = np.bincount(where[by][fresh], minlength=n) / np.maximum(np.bincount(where, minlength=n), 1)
    # hashed trigrams of bytes and hashed words, as the square root of their shares
    if len(data) > 2:
        codes = data.astype(np.uint32)
        three = ((codes[:-2] * 0x9E3779B1 ^ codes[1:-1] * 0x85EBCA6B ^ codes[2:] * 0xC2B2AE35) >> np.uint32(15)) % BUCKETS
        grams = np.bincount(text[:-2] * BUCKETS + three, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, SURFACE : SURFACE + BUCKETS] = np.sqrt(grams / size[:, None])
    named = np.bincount(of * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, SURFACE + BUCKETS :] = np.sqrt(named / many[:, None])
    return out


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.03, decay: float = 1e-4):
    """Weights of a linear scorer, the last a constant.

    The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with
    the logistic loss. Where the second part falls under 0, the step goes up its
    gradient alone. All rows count in each step, so runs agree.
    """
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for t in range(1, rounds + 1):
        at = w.astype(p.dtype)
        fp, fu = p @ at, u @ at
        as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        g = -g_negative if as_negative < 0 else g_negative - prior * (p.T @ sigmoid(-fp)) / len(p)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05) -> float:
    """The share of positives among the unlabelled, from trusted positives and unlabelled rows alone.

    A scorer of positive against unlabelled is learnt on every second row of each and applied to the others. Where it
    scores highest the unlabelled are positives too, so the least ratio of the unlabelled to the positives that
    it puts over a threshold, taken over all thresholds that ``least`` of the positives pass, bounds the share from above.
    Deviations of both counts that one in ten samples has are added, so that few rows don't make it small by chance.
    """
    w = non_negative_risk(positive[::2], unlabelled[::2], 0.5, rounds=300)
    fp, fu = (np.sort(x[1::2] @ w[:-1]) for x in (positive, unlabelled))
    if not len(fp) or not len(fu):
        return 0.5
    cuts = fp[: max(1, int(len(fp) * (1 - least)))]
    over = lambda f: (len(f) - np.searchsorted(f, cuts, "left")) / len(f)
    slack = np.sqrt(np.log(40) / 2) * (len(fu) ** -0.5 + len(fp) ** -0.5)
    p, u = over(fp), over(fu)
    at = int(np.argmin((u + slack) / p))
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def _featured(docs: DataFrame, *kept: str) -> DataFrame:
    def run(batches):
        for piece, data, bounds in in_units(batches, UNIT_BYTES):
            rows = pa.array(list(features(data, bounds).astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [rows], [*kept, "x"])

    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", x array<float>")


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train_quality(docs: DataFrame, labels: DataFrame, seed: int = 11) -> dict:
    """Centre, spread, weights and prior from the rows that aren't held out.

    Trusted positives are training labels of 1; unlabelled web text is rows
    without a label. Labels of 0 are not used: the prior too is estimated from the other two. Samples are the
    first rows by hash of the id, up to the module's bounds; labels outside 0 and 1 and null ids are left aside; rows that
    repeat an id all count. Without a positive or an unlabelled row every score is one half.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out() & (F.col("quality") == 1))
    mixed = F.xxhash64("doc_id", F.lit(seed))
    positive = known.select("doc_id").distinct().orderBy(mixed).limit(POSITIVES).withColumn("kind", F.lit(1))
    bare = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    bare = bare.join(labels.select("doc_id"), "doc_id", "left_anti").orderBy(mixed).limit(UNLABELLED).withColumn("kind", F.lit(0))
    chosen = positive.union(bare)
    # at most POSITIVES + UNLABELLED ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = _featured(sample, "doc_id", "kind").orderBy("kind", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "x").toPandas()
    kind = rows.kind.to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return {"centre": np.zeros(N_FEATURES), "spread": np.ones(N_FEATURES), "weights": np.zeros(N_FEATURES + 1), "prior": 0.5}
    x = np.stack(rows.x.to_list())
    centre, spread = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
    # many hashed columns fit a small sample by chance, so each counts for less
    spread[SURFACE:] *= DAMPED
    z = np.clip((x - centre.astype(np.float32)) / spread.astype(np.float32), -8, 8)
    del rows, x
    prior = estimated_prior(z[kind == 1], z[kind == 0])
    return {"centre": centre, "spread": spread, "weights": non_negative_risk(z[kind == 1], z[kind == 0], prior), "prior": prior}


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, how likely its ``text`` is of quality 1.

    Whole texts count; null and empty ones get the score of an empty text. Rows
    may repeat, other columns are kept, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score"]
    centre, spread, weights = model["centre"], model["spread"], model["weights"]

    def run(batches):
        for piece, data, bounds in in_units(batches, UNIT_BYTES):
            z = np.clip((features(data, bounds) - centre) / spread, -8, 8)
            score = 0.5 * (1 + np.tanh((z @ weights[:-1] + weights[-1]) / 2))
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [pa.array(score)], [*kept, "score"])

    schema = docs.select(*kept).schema.add("score", "double")
    return docs.select(*kept).mapInArrow(run, schema)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from training labels only."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
