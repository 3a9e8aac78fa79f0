import random

import corpus_pipeline
import numpy as np
import pytest

from arcwise.llm import nearcopies


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_kept(texts):
    """The smallest id of each group by exact similarity of every pair."""
    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i for i in ids if group[i] == i}


def near_threshold(pairs=150):
    """Pairs of different texts: k new words at the end give a similarity of (n - k) / (n + k), from 0.75 to 0.9."""
    r = random.Random(7)
    texts = {}
    for p in range(pairs):
        size = (40, 90, 180)[p % 3]
        words = [f"w{r.randrange(10**6)}" for _ in range(size + 4)]
        k = round(size * (0.111, 0.105, 0.115, 0.053, 0.14)[p % 5])
        texts[2 * p] = " ".join(words)
        texts[2 * p + 1] = " ".join(words[:-k] + [f"x{r.randrange(10**6)}" for _ in range(k)])
    return texts


def stage(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}


@pytest.mark.parametrize("rows", [1024, 2])
def test_links_are_exact(spark, monkeypatch, rows):
    """Every pair of 0.8 or more links and no other, in whole groups and in parts that meet."""
    monkeypatch.setattr(nearcopies, "PART_ROWS", rows)
    texts = near_threshold()
    chain = [f"c{k}" for k in range(120)]
    texts |= {1000 + s: " ".join(chain[s * 5 : s * 5 + 60]) for s in range(12)}  # each links to the next alone
    texts |= {2000 + s: " ".join(chain[::-1] + [f"e{s}"]) for s in range(9)}
    want = brute_kept(texts)
    assert 100 < len(want) < len(texts) - 60
    assert stage(spark, texts) == want


def test_set_forest():
    r = np.random.default_rng(5)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.where(r.random(100) < 0.12, r.integers(1000, 1100, 100), base).astype(np.uint64)) for _ in range(30)]
    near = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    group = np.arange(30)
    for _ in range(30):
        for a in range(30):
            for b in range(30):
                if near[a][b]:
                    group[a] = group[b] = min(group[a], group[b])
    found = nearcopies.set_forest(sets, 4, 5)
    assert (found[:, None] == found).tolist() == (group[:, None] == group).tolist()
