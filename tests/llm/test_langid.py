"""Naive Bayes against a plain version, and its accuracy on texts kept out of training."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from arcwise.llm import langid, queries

SYLLABLES = {"xx": "the and ing ion er sh ou", "yy": "sch ein ung ä ö ch der", "zz": "ión ado que ñ os ar la", "ελ": "και της ον ας ει ου τα"}


def some_texts(n, seed=4):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 4]
        parts = SYLLABLES[lang].split()
        words = ["".join(r.choice(parts, int(r.integers(1, 4)))) for _ in range(int(r.integers(3, 60)))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def plain_grams(text):
    runs = "".join(c if c.isalpha() else " " for c in text.lower())
    marked = " " + " ".join(runs.split()) + (" " if runs.split() else "")
    out, mask = Counter(), (1 << 32) - 1
    for size in langid.SIZES:
        for k in range(len(marked) - size + 1):
            state = 0
            for j, c in enumerate(marked[k : k + size]):
                state = (state * 0x9E3779B1 + ord(c) + j + 1) & mask
            out[((state ^ (state >> 15)) * 0x85EBCA6B & mask) >> 16] += 1
    return out


def plain_scores(train, texts):
    langs = sorted({lang for _, _, lang in train if lang is not None})
    counts, docs = {x: Counter() for x in langs}, Counter()
    for _, text, lang in train:
        if lang is not None:
            counts[lang] += plain_grams(text or "")
            docs[lang] += 1
    for text in texts:
        if not any(map(str.isalpha, text or "")):
            yield "und", 0.0
            continue
        logs = []
        for x in langs:
            all_ = sum(counts[x].values()) + langid.ADDED * langid.BUCKETS
            logs.append(math.log(docs[x] / docs.total()) + sum(n * math.log((counts[x][b] + langid.ADDED) / all_) for b, n in plain_grams(text).items()))
        best = max(range(len(langs)), key=lambda k: logs[k])
        yield langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs)


def test_against_plain(spark):
    rows = [*some_texts(40), (40, None, "xx"), (41, "12 — 3!", "yy"), (42, "", "zz"), (43, "the", None), (None, "ŞİIßǅ " * 50, "xx"), (1, "the and", "xx"), (1, "the and", "xx")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    model = langid.train_languages(docs)
    assert model["langs"] == sorted(SYLLABLES)
    asked = [t for _, t, _ in some_texts(40, 9)] + ["the", "sch 7", "x", None, "", " \n", "42!", "ﬁ Ⅷ", "Ⅷ", "the and ing " * 3000, "İ"]
    table = spark.createDataFrame([(i, t, i, "kept") for i, t in enumerate(asked)], "k long, text string, score int, lang string").repartition(2)
    done = langid.predict_languages(table, model)
    assert done.columns == ["k", "text", "lang", "lang_pred", "score"]
    got = {r.k: r for r in done.collect()}
    for i, (lang, score) in enumerate(plain_scores(rows, asked)):
        assert (got[i].lang_pred, got[i].text, got[i].lang) == (lang, asked[i], "kept")
        assert got[i].score == pytest.approx(score, abs=2e-3)


def test_edges(spark):
    docs = spark.createDataFrame([("the and", "xx")], "text string, lang string")
    none = langid.train_languages(docs.limit(0))
    assert [tuple(r) for r in langid.predict_languages(docs, none).select("lang_pred", "score").collect()] == [("und", 0.0)]
    one = langid.train_languages(docs)
    assert [tuple(r) for r in langid.predict_languages(docs, one).select("lang_pred", "score").collect()] == [("xx", 1.0)]
    assert langid.predict_languages(docs.limit(0), one).count() == 0
    # languages that are alike in all are told apart by name alone
    twins = langid.train_languages(spark.createDataFrame([("the", "b"), ("the", "a")], "text string, lang string"))
    assert langid.predict_languages(docs, twins).first().lang_pred == "a"


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.train_languages(spark.createDataFrame([(t, lang) for _, t, lang in some_texts(4)], "text string, lang string"))


def test_op12(spark, tmp_path):
    rows = some_texts(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    # languages of held-out rows are swapped, which must change nothing
    told = [(i, t, ("wrong" if held(i) else lang), "s") for i, t, lang in rows]
    spark.createDataFrame(told, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op12_gram_bayes"](spark, str(tmp_path)).collect()}
    assert all(got[i].held_out == held(i) for i, _, _ in rows)
    outside = [i for i, _, _ in rows if held(i)]
    assert len(outside) > 50 and sum(got[i].lang_pred == rows[i][2] for i in outside) >= 0.98 * len(outside)
