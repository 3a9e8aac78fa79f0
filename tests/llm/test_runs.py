"""Periodic runs against all stretches of all periods in plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from arcwise.llm import queries, runs
from tests.llm.test_operators import RUN, split


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if (n := k - start + q) >= max(least, 2 * q):
                found.setdefault((start, n), q)  # the smallest period comes first
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def word_lists():
    r = np.random.default_rng(5)
    yield from ([], ["a"] * 11, ["a"] * 12, ["a"] * 500, ["a", "b"] * 40, ["a", "b", "c"] * 5 + ["a"], fibonacci(300))
    for alphabet in (1, 2, 3, 5):
        for _ in range(60):
            yield [f"w{k}" for k in r.integers(0, alphabet, int(r.integers(0, 90)))]
    for _ in range(60):
        words = []
        while len(words) < 150:
            part = [f"w{k}" for k in r.integers(0, 40, int(r.integers(1, 12)))]
            words += (part * 12)[: int(r.integers(len(part), 6 * len(part) + 1))]
        yield words


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_of(least):
    for words in word_lists():
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(ids):
            assert runs.runs_of(ids, least) == brute_runs(words, least)


def test_periodic_runs(spark):
    texts = [" \t ".join(w) + "\n" for w in word_lists()] + [None, "", "\v\f", "z " * 20_000, "ä b c " * 9, RUN + " " + RUN]
    rows = [(i % 50 or None, t, [i], f"x{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, start string").repartition(3)
    done = runs.periodic_runs(docs)
    assert done.columns == ["doc_id", "text", "start", "n_words", "runs", "collapsed"]
    got = {r.start: r for r in done.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, words = got[f"x{i}"], split(text)
        want = [(0, 20_000, 1)] if text and len(text) > 30_000 else brute_runs(words)
        assert (r.text, r.n_words, [tuple(x) for x in r.runs]) == (text, len(words), want)
        assert r.collapsed == brute_collapsed(words, want)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, 3)


def test_op11(spark, tmp_path):
    r = np.random.default_rng(2)
    lists = list(word_lists())[-120:] + [[f"v{k}" for k in r.integers(0, 3000, int(r.integers(1, 400)))] for _ in range(200)]
    rows = [(i, " ".join(w), i) for i, w in enumerate(lists)] + [(1000, None, 0), (1007, "", 0), (None, RUN + " " + RUN, 0), (3, "again " * 30, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, g int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for i, text, _ in rows:
        words = split(text)
        n = len(words)
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        found = brute_runs(words)
        s, length, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((i, len(found), s, length, q, 1000 * length // q if found else None, digest(lines), digest(brute_collapsed(words, found))))
    assert planted > 10
    got = queries.QUERIES["op11_lcp_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
