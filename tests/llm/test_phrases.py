"""Collocations against plain counting, also with prefixes over the budget at every depth."""

import re
from collections import Counter

import numpy as np
import pytest

from arcwise.llm import phrases, queries


def plain(rows, least=30, share=80, top=2000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    counts[lang, tuple(words[k : k + m])] += 1
    found = []
    kept = {key: f for key, f in counts.items() if f >= least and len(key[1]) > 1}
    dropped = set()
    for (lang, p), f in kept.items():
        for m in range(2, len(p)):
            for k in range(len(p) - m + 1):
                if 100 * f >= share * counts[lang, p[k : k + m]]:
                    dropped.add((lang, p[k : k + m]))
    for (lang, p), a in kept.items():
        if (lang, p) not in dropped:
            score, _, left, right = min((2_000_000 * a // ((x := counts[lang, p[:k]]) + (y := counts[lang, p[k:]])), k, x, y) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def some_rows(n=150, seed=1):
    r = np.random.default_rng(seed)
    words = ["the", "of", "und", "der", "ß", "Ä", "é", "|", "x", "New", "York", "city", "a", "b", " y"]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        parts = [w + str(r.choice(["", "", "", "", ".", ",", "\n", "\t"])) for w in r.choice(words, int(r.integers(0, 80)), p=weight / weight.sum())]
        rows.append((["en", "de", None][i % 3], " ".join(parts)))
    rows += [("en", None), ("de", ""), (None, " .,;"), ("fr", "la vie en rose. " * 40), ("fr", "La vie " * 5), ("", "q r " * 31), ("und", "the of the")]
    return rows


@pytest.mark.parametrize("budget", [1 << 20, 300, 40, 3])
def test_collocations(spark, budget):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "lang string, text string, n int, k1 string").repartition(3)
    got = phrases.collocations(docs, least=30, top=60, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, top=60))


def test_small_units(spark, monkeypatch):
    """Units of a few texts, and words ordered a few at a time, give the same counts (in this process)."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "UNIT_BYTES", 300)
    monkeypatch.setattr(phrases, "ORDERED", 200)
    rows = [(lang or "und", text or "") for lang, text in some_rows(60)]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    coded = [b for b in phrases.encoded_units(0)(iter([batch]))]
    slots = phrases.Slots(1 << 16)
    words = {(x["lang"], x["word"]): x["key"] for b in phrases.counted_words(slots)(iter(coded)) for x in b.to_pylist()}
    totals = Counter()
    for b in phrases.counted_words(slots)(iter(coded)):
        totals.update({x["lang"]: x["n"] for x in b.to_pylist() if x["key"] == 0})
    words = {k: v for k, v in words.items() if v}
    names = {k: w for (_, w), k in words.items()}
    langs = {k: lang for (lang, _), k in words.items()}
    cuts = np.sort(np.array(list(words.values()), np.uint64))[::5]
    cuts = np.stack([cuts, *[np.zeros(len(cuts), np.uint64)] * 3], 1)
    pieces = [b.to_pandas() for b in phrases.grouped_suffixes(cuts, np.zeros((0, 4), np.uint64), slots)(iter(coded))]
    found = {}
    import pandas as pd

    for _, group in pd.concat(pieces).groupby("grp"):
        for *keys, f in phrases.subtree_counts(1)(group).itertuples(index=False):
            keys = [k for k in keys if k]
            key = langs[keys[0]], tuple(names[k] for k in keys)
            assert key not in found
            found[key] = f
    want, all_words = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            all_words[lang] += len(w)
            for m in (2, 3, 4):
                want.update((lang, tuple(w[k : k + m])) for k in range(len(w) - m + 1))
    assert found == want
    assert totals == Counter({lang: n for lang, n in all_words.items() if n})


def test_ties_and_empty(spark):
    # many phrases with equal scores and counts: the first by bytes are kept
    rows = [("en", f"w{k} v{k}.") for k in range(40) for _ in range(30)] + [("en", f"é{k} z.") for k in range(3) for _ in range(31)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = phrases.collocations(docs, top=7)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, top=7))
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.limit(5)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("x", " ")], "lang string, text string")).count() == 0


def test_colliding_words(spark, monkeypatch):
    """A seed under which two words share a hash is given up."""
    rows = [("en", "a b c d. " * 35)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    usual, tried = phrases.encoded_units, []

    def units(seed):
        tried.append(seed)
        run = usual(seed)

        def same(batches):
            import pyarrow as pa

            for b in run(batches):
                keys = np.full(len(b.column("vocabulary")[0].as_py()) // 8, 7, "<u8")
                yield b.set_column(1, "vocabulary", pa.array([keys.tobytes()], pa.binary()))

        return same if seed == 0 else run

    monkeypatch.setattr(phrases, "encoded_units", units)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == sorted(plain(rows))
    assert tried == [0, 1]


def test_op13(spark, tmp_path):
    rows = some_rows(200, 8)
    spark.createDataFrame([(i, *r, "s") for i, r in enumerate(rows)], "doc_id long, lang string, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.QUERIES["op13_prefix_groups"](spark, str(tmp_path)).collect())) == sorted(plain(rows))


def test_batches_are_bounded_in_bytes(spark):
    """Rows of a megabyte come a few at a time, however many a batch may have."""
    from arcwise.llm.tables import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given in ("64m", "67108864b", "1g"):
            spark.conf.set(key, given)
            small_batches(spark)
            assert spark.conf.get(key).rstrip("b") == str(8 << 20)
        spark.conf.set(key, "1k")
        small_batches(spark)
        assert spark.conf.get(key) == "1k"
        spark.conf.set(key, 8 << 20)
        rows = spark.range(0, 40, 1, 1).selectExpr("CAST(repeat('x', 1 << 20) AS BINARY) AS b")

        def most(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

        assert max(r.n for r in rows.mapInArrow(most, "n long").collect()) <= 10
    finally:
        spark.conf.set(key, before)


def test_suffixes_end_before_rare_triples():
    """A suffix whose triples are rare is sent as a pair, though all of its pairs are frequent; what is written is packed."""
    import pyarrow as pa

    text = "a b c. " * 30 + "b c d. " * 30 + "a b x. c d. b x. " * 30 + "a b c d. "
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    (unit,) = phrases.encoded_units(0)(iter([batch]))
    (units,) = phrases._gathered([unit])
    every = phrases.Slots(1 << 20)
    vocabulary, ids, _, _ = phrases._read_units(units, every)
    assert (vocabulary == np.sort(vocabulary)).all() and len(vocabulary) == 5 and len(ids) == 30 * 3 + 30 * 3 + 30 * 7 + 4
    n, found = Counter(), {}
    for size in (2, 3):
        found[size] = np.zeros((1 << 20) // 8, np.uint8)
        for batch in phrases.slot_counts(every, size, 31)([unit]):
            for row in batch.to_pylist():
                which = phrases.unpack_rising(phrases._unzipped(row["slots"])) + row["block"] * phrases.BLOCK_SLOTS
                n[size] += len(which)
                for slot, times in zip(which, phrases.unpack(phrases._unzipped(row["times"])), strict=True):
                    found[size][slot >> 3] |= (times >= 31) << (7 - (slot & 7))
    assert n == {2: 4, 3: 3}  # ab, bc, cd, bx; abc, bcd, abx
    pairs_only, both = phrases.Slots(1 << 20, pairs=found[2]), phrases.Slots(1 << 20, pairs=found[2], triples=found[3])
    lengths = lambda slots: Counter((phrases._hashes(*(x := phrases._suffixes(units, slots))[:3]) != 0).sum(1).repeat(x[3]).tolist())
    # abc and bcd come 31 times; abx comes 30 times and now ends after its pair
    assert lengths(pairs_only)[3] == 91 and lengths(both)[3] == 61 and lengths(both)[4] == 1
