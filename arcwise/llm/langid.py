"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import read, small_batches
from arcwise.llm.words import in_units

#: Lengths of the n-grams, buckets they are hashed to (16 bits; a batch has 2^16 texts at most), what is added to each count, text of a unit.
SIZES, BUCKETS, ADDED, UNIT_BYTES = (1, 2, 3, 4), 1 << 16, 0.5, 1 << 18
#: Languages a model may have: with four bytes a number its matrix has 128 MB then. More are an error.
MOST_LANGUAGES = 512
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a space at its start and one in place of whatever is between letters; the text of each."""
    marked = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[np.cumsum(sizes) - sizes] = True
    return np.where(letter, points, 0x20)[kept], of[kept]


def hashed_grams(points: np.ndarray, of: np.ndarray, label: np.ndarray):
    """For each length the n-grams as numbers, their text's label above and the bucket in the low 16 bits; none crosses texts."""
    codes, state = points.astype(np.uint32), np.zeros(len(points), np.uint32)
    shifted = (label.astype(np.uint32) << np.uint32(16))[of]
    for size in range(1, max(SIZES) + 1):
        n = len(points) - size + 1
        if n <= 0:
            return
        state = state[:n] * np.uint32(0x9E3779B1) + codes[size - 1 :] + np.uint32(size)
        if size in SIZES:
            bucket = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)
            keys = shifted[:n] | bucket
            yield keys if size == 1 else keys[of[:n] == of[size - 1 :]]


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [t or "" for t in piece.column("text").to_pylist()]


def gram_counts(batches):
    """A partition's counts: ``lang, bucket, n``, and its texts under bucket -1."""
    counts, docs = {}, {}
    for piece, _, _ in in_units(batches, UNIT_BYTES):
        langs, index = np.unique(np.array(piece.column("lang").to_pylist(), object), return_inverse=True)
        for lang, n in zip(langs, np.bincount(index), strict=True):
            docs[lang] = docs.get(lang, 0) + int(n)
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
        points, of = letter_runs(_texts(piece))
        for keys in hashed_grams(points, of, index):
            both = np.bincount(keys, minlength=len(langs) * BUCKETS).reshape(-1, BUCKETS)
            for k, lang in enumerate(langs):
                counts[lang] += both[k]
    for lang, row in counts.items():
        found = np.flatnonzero(row)
        names = pa.array([lang] * (len(found) + 1), pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(row[found], docs[lang]))], ["lang", "bucket", "n"])


def train_languages(docs: DataFrame) -> dict:
    """A model from all rows of ``lang, text`` with a non-null ``lang``: languages in order, log-probabilities, log-priors.

    Each partition sends one count for each language and bucket that it has, whatever its rows, so no language is one task's.
    What comes to the driver is the sum of these, at most BUCKETS for each of MOST_LANGUAGES. Null texts have no n-grams;
    rows that repeat all count. Without a row the model knows no language.
    """
    small_batches(docs.sparkSession)
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL")
    parts = known.mapInArrow(gram_counts, "lang string, bucket int, n long")
    summed = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table: pd.DataFrame = summed.toPandas()
    langs = sorted(set(table.lang))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model has {MOST_LANGUAGES} at most")
    place = table.lang.map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)
    bucket, n = table.bucket.to_numpy(), table.n.to_numpy()
    gram = bucket >= 0
    counts = np.full((len(langs), BUCKETS), ADDED)
    counts[place[gram], bucket[gram]] += n[gram]
    rows = np.zeros(len(langs))
    rows[place[~gram]] = n[~gram]
    logs = np.log(counts) - np.log(counts.sum(1, keepdims=True)) if langs else counts
    return {"langs": langs, "logs": logs.astype(np.float32), "priors": np.log(rows / rows.sum()) if langs else rows}


def log_likelihoods(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language the sum of its n-grams' log-probabilities, and whether the text has a letter.

    The batch is a sparse matrix of texts and buckets, one entry for each bucket a text has, multiplied by the matrix of logs.
    """
    points, of = letter_runs(texts)
    keys = np.sort(np.concatenate([np.zeros(0, np.uint32), *hashed_grams(points, of, np.arange(len(texts)))]))
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    times = np.diff(np.append(start, len(keys)))
    text, bucket = (keys[start] >> np.uint32(16)).astype(np.int64), (keys[start] & np.uint32(0xFFFF)).astype(np.int64)
    out = np.stack([np.bincount(text, times * row[bucket], minlength=len(texts)) for row in logs], 1) if len(logs) else np.zeros((len(texts), 0))
    return out, np.bincount(of[points != 0x20], minlength=len(texts)) > 0


def predict_languages(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language by its whole ``text``.

    Of equal languages the first by code point is taken. Null texts, texts without a letter, and all texts if the model knows no language
    are ``und`` with a score of 0. Rows may repeat, other columns are kept, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    # MOST_LANGUAGES rows of BUCKETS numbers at most
    shared = spark.sparkContext.broadcast((model["langs"], model["logs"], model["priors"]))

    def run(batches):
        langs, logs, priors = shared.value
        for piece, _, _ in in_units(batches, UNIT_BYTES):
            found, lettered = log_likelihoods(_texts(piece), logs)
            names, score = [UNKNOWN] * piece.num_rows, np.zeros(piece.num_rows)
            if langs:
                total = found + priors
                best = total.argmax(1)
                top = total.max(1, keepdims=True)
                score = np.where(lettered, 1 / np.exp(total - top).sum(1), 0.0)
                names = [langs[b] if has else UNKNOWN for b, has in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept).mapInArrow(run, schema)


def op12_gram_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the training documents that name theirs."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train_languages(docs.where(~held).select("lang", "text"))
    return predict_languages(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
