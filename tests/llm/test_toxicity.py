import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import toxicity as tx
from proofline.llm.lexical import terms_of

BAD = ["zorfle", "grubnik", "pestwort"]


def text(rng, toxic, most=120):
    words = [rng.choice(["stone", "river", "lamp", "over", "and", "the", "green", "walks"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(3, most))]
    for _ in range(2 * toxic):
        words.insert(rng.randint(0, len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


@pytest.fixture(scope="module")
def net(judged):
    return tx.fit_toxicity(judged.drop("toxic"), judged.drop("text"), steps=120)


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(tx, "_F", np.float64)
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + rng.normal(size=v.shape) * 0.1 for k, v in tx.fresh(3, rng).items()}
    x = rng.normal(size=(7, tx.WORD_DIMS + tx.CHAR_DIMS))
    at = rng.integers(0, 7, (4, tx.WIDTH))
    mask = np.arange(tx.WIDTH) < np.array([tx.WIDTH, tx.WIDTH, 5, 0])[:, None]
    y = np.array([1.0, 0, 1, 0])
    _, grads, dx = tx.gradients(p, x, at, mask, y)
    loss = lambda q, z: tx.gradients(q, z, at, mask, y)[0]
    for k, g in grads.items():
        i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in "12")
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((loss(up, x) - loss(down, x)) / 2e-5 - g[i]) < 1e-6, k
    up, down = x.copy(), x.copy()
    up[2, 3] += 1e-5
    down[2, 3] -= 1e-5
    assert abs((loss(p, up) - loss(p, down)) / 2e-5 - dx[2, 3]) < 1e-6


def plain_score(net, raw):
    """One word and one window at a time."""
    p, words = net.params, terms_of(raw)
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def sent(w):
        cells, _ = tx.trigrams([w])
        return np.concatenate([p["word"][net.vocabulary.get(w, 0)], p["char"][cells].mean(0)]) @ p["W"] + p["b"]

    def run(seq, d):
        h, out, n = np.zeros(tx.HIDDEN), [], tx.HIDDEN
        for w in seq:
            g, a = sent(w)[3 * n * d : 3 * n * (d + 1)], h @ p["U"][d]
            z, r = logistic(g[:n] + a[:n]), logistic(g[n : 2 * n] + a[n : 2 * n])
            h = (1 - z) * np.tanh(g[2 * n :] + r * (a[2 * n :] + p["c"][d])) + z * h
            out.append(h)
        return out

    best, start = -np.inf, 0
    while True:
        begin = max(0, min(start, len(words) - tx.WIDTH))
        seq = words[begin : begin + tx.WIDTH]
        states = [np.concatenate(x) for x in zip(run(seq, 0), reversed(run(seq[::-1], 1)))]
        pooled = np.zeros(2 * tx.HIDDEN)
        if states:
            e = np.exp([np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in states])
            pooled = (np.array(states) * (e / e.sum())[:, None]).sum(0)
        best = max(best, float((pooled @ p["w"] + p["o"])[0]))
        if begin + tx.WIDTH >= len(words):
            return logistic(best)
        start += tx.STEP


def test_scores_equal_a_plain_reading(net):
    rng = random.Random(9)
    some = [text(rng, i % 2, m) for i, m in enumerate([5, 20, 31, 40, 70, 100, 200])] + ["", "zorfle", "!!", "é" * 50, "a " * 33]
    got = tx.score_texts(net, [t.encode() for t in some])
    assert np.allclose(got, [plain_score(net, t.encode()) for t in some], atol=1e-4)


def test_windows_cover_every_passage_of_half_their_width():
    for n in range(200):
        starts = tx.windows_of(n)
        assert starts[0] == 0 and starts[-1] == max(0, n - tx.WIDTH) and (np.diff(starts) <= tx.STEP).all()
        assert all(any(s <= a and a + tx.STEP <= s + tx.WIDTH for s in starts) for a in range(n - tx.STEP + 1))


def test_held_out_texts(spark, net):
    rng = random.Random(77)
    rows = [(i, text(rng, i % 3 == 0, 400), int(i % 3 == 0)) for i in range(300)]
    rows.append((300, "river " * 20_000 + "zorfle grubnik" + " river" * 20_000, 1))
    got = tx.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, truth int"), net).collect()
    assert sum(r.predicted == r.truth for r in got) >= 0.97 * len(got)
    assert got[-1].predicted == 1 and all(r.predicted == (r.score >= 0.7) for r in got)


def test_odd_texts_and_clashing_names(spark, docs, net):
    df = docs().withColumn("score", F.lit("x")).withColumn("predicted", F.lit(None).cast("string")).withColumn("words", F.lit(1))
    got = tx.score_toxicity(df, net)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "words", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert tx.score_toxicity(df.where("false"), net).count() == 0


def test_labels_of_one_class_or_none_and_repeats(spark, judged):
    docs_ = judged.drop("toxic")
    clean = tx.fit_toxicity(docs_, judged.drop("text").where("toxic = 0"))
    assert {r.score for r in tx.score_toxicity(docs_, clean).collect()} == {0.0}
    none = tx.fit_toxicity(docs_, judged.drop("text").withColumn("toxic", F.lit(None).cast("int")))
    assert none.constant == 0.0
    labels = judged.drop("text")
    twice = tx.fit_toxicity(docs_.unionByName(docs_), labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int"))), steps=8)
    assert twice.constant is None


def test_sample_is_bounded(spark, judged):
    few = tx.fit_toxicity(judged.drop("toxic"), judged.drop("text"), most_rows=20, most_chars=4000, steps=4)
    assert len(few.vocabulary) < 40
