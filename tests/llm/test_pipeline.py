import random

import corpus_pipeline
from arcwise.llm import mixing, substrings
from arcwise.llm.tables import parted



def test_stages(spark, tmp_path):
    text = lambda seed, n=80: " ".join(f"{'abcdefg'[(seed * k) % 7]}o{(seed * 31 + k * k) % 97}" for k in range(n))
    rows = [(i, text(i + 1), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30, rows[0][1], "en", "s0"), (31, rows[1][1] + " end", "en", None), (32, None, None, None), (33, "", "en", "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, now, str(tmp_path)).collect()}
    assert kept == set(range(30)) | {32}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in last)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_parted(spark):
    """Every row comes once, all that are asked for among the first, and few others with them."""
    rows = spark.range(-500, 5000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE id * 7919 END AS doc_id", "id AS n")
    some = rows.where("n % 50 = 3 AND n > 0").select("doc_id")
    hit, miss = parted(rows, some)
    assert hit.columns == miss.columns == rows.columns
    assert sorted(r.n for r in hit.union(miss).collect()) == list(range(-500, 5000))
    assert some.exceptAll(hit.select("doc_id")).count() == 0 and miss.join(some, "doc_id").count() == 0
    assert hit.count() < 100 + 5400 / 8 and hit.where("doc_id IS NULL").count() == 0
    hit, miss = parted(rows, some.limit(0))
    assert hit.count() == 0 and miss.count() == 5500


def test_few_texts_move(spark, monkeypatch):
    """Where tables are too large to be broadcast, texts that no join changes are not shuffled."""
    r = random.Random(3)
    # sources of weights 5, 2 and 1: all copies are alike in the first two
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(200)) for _ in range(600)]
    texts[1::60] = [texts[0]] * 10
    docs = spark.createDataFrame([(i, t, "abc"[i % 3] if i % 10 else "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").repartition(4).cache()
    size = sum(map(len, texts))
    store = spark._jsparkSession.sparkContext().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    key = "spark.sql.autoBroadcastJoinThreshold"
    docs.count()
    want = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    left = sorted(map(tuple, substrings.remove_repeats(docs).collect()))
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        start = written()
        assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == want
        mixed = written() - start
        found = substrings.remove_repeats(docs)
        start = written()
        assert sorted(map(tuple, found.collect())) == left
        moved = written() - start
    finally:
        spark.conf.set(key, before)
    assert mixed < size / 4 and moved < size / 4
