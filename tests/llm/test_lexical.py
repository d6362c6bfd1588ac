import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import lexical as lx

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """(item, rank, id, score) by the formula, word by word."""
    texts = [(i, terms(t)) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, length = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, t in texts:
            m = 50 + (50 * len(t) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c) // (1000 * c + 20 * m))
                for w in own if (c := t.count(w))
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if nul else i, -s) for r, (s, nul, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in lx.ranked_search(docs, items, **options).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in "UVWxyz日"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 42])]) for _ in range(rng.randint(0, 60)))
    return [(i, text()) for i in range(n)], [(i, text()) for i in range(25)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(lx, "CELLS", 2000)
    docs, items = corpus(400, seed)
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties beyond k
    docs += [(1000, docs[7][1]), (None, docs[7][1]), (None, None), (5000, ""), (5001, "!? -"), (5002, "ax ay " * 30_000)]
    items += [(3, "aX bx"), (None, "cz"), (None, "cy CZ"), (70, None), (71, "nowhere"), (72, docs[7][1]), (73, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    want = brute(docs, items, 10)
    assert found(d, q, k=10) == want
    # The same from several blocks of items, and with k-th scores taken from a sample first.
    assert found(d.repartition(3), q, k=10, block_bytes=2000, seed_rows=50) == want


def test_nothing_to_search(spark):
    d = spark.createDataFrame([(1, "ax")], "doc_id long, text string")
    q = spark.createDataFrame([("i", "AX ax")], "item_id string, text string")
    assert found(d, q) == brute([(1, "ax")], [("i", "ax")], 50)
    assert lx.ranked_search(d, q).columns == ["item_id", "rank", "doc_id", "score"]
    assert found(d.where("false"), q) == [] and found(d, q.where("false")) == []
    assert found(d, q.withColumn("text", F.lit(None).cast("string"))) == []


def test_whole_nodes_are_pruned():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 9000, 400)
    items = [np.unique(50 * (i % 8) + rng.integers(0, 50, 12)) for i in range(30)]  # of eight subjects
    root = lx.item_tree(items, weights)
    index = lx.Index(root, lx.facets(root), weights, 1000, 100_000, 5, np.float64)
    best = lx.Best(5, 30, np.ones(30, np.int64))
    sizes = rng.integers(1, 60, 512)
    rows = np.repeat(np.arange(512), sizes)
    held = np.unique(np.stack([rows, 50 * (rows % 8) + rng.integers(0, 50, sizes.sum())]), axis=1)
    values = rng.integers(1, 500_000, held.shape[1])
    tree = lx.DocumentTree(index, held[0], held[1], values, sizes, np.zeros(512, bool), np.arange(512))
    pairs = tree.search(best)
    assert pairs < 0.4 * 512 * 30
    impact = np.zeros((512, 400), np.int64)
    impact[held[0], held[1]] = values
    for i, own in enumerate(items):
        scores = impact[:, own] @ weights[own]
        want = np.lexsort((np.arange(512), -scores))[:5]
        assert best.found[i][2].tolist() == want.tolist() and best.found[i][0].tolist() == scores[want].tolist()


def test_impacts_beyond_64_bits():
    n = np.array([10**9], np.int64)
    assert lx.impacts(np.array([3]), n, 10**11, 10**13)[0] == 3 * 10**9 // (3000 + 20 * (50 + 50 * 10**20 // 10**13))
