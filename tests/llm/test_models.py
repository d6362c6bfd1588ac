import random

import pytest
from pyspark.sql import functions as F

from proofline.llm import language as lang
from proofline.llm import quality as q
from proofline.llm.common import remainder_of_id

SYLLABLES = {"aa": "ba be bo da de", "bb": "ku ko kra kro ski", "cc": "łą żó ść ńa źe", "dd": "ma na la"}


def texts(code, n, seed=0):
    rng = random.Random(f"{code}{seed}")
    word = lambda: "".join(rng.choice(SYLLABLES[code].split()) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(n)]


def labelled(spark, codes=("aa", "bb", "cc")):
    rows = [(i, t, c) for c in codes for i, t in enumerate(texts(c, 60))]
    rows += [(1000 + i, t, "aa") for i, t in enumerate(texts("bb", 3, 1))]  # mislabelled
    rows += [(2000, None, "aa"), (2001, "", "bb"), (2002, "text", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_held_out_and_odd_texts(spark):
    filters = lang.learn_filters(labelled(spark))
    assert filters.languages == ["aa", "bb", "cc"]
    new = [(c, t) for c in filters.languages for t in texts(c, 40, 9)]
    assert sum(filters.predict(t)[0] == c for c, t in new) >= 0.98 * len(new)
    for t in (None, "", " ", "12 34 !?", "½ ² ³", "😀"):
        assert filters.predict(t) == ("und", 0.0)
    assert filters.predict("日本") == ("aa", 0.0)
    assert filters.predict("BA BE bo")[0] == "aa"
    assert 0 < filters.predict("ku ko " * 100_000)[1] <= 1


def test_filters_answer_for_all_languages_at_once(spark):
    filters = lang.learn_filters(labelled(spark), cells=1 << 16)
    own = filters.shares(" ".join(texts("cc", 5, 4)))
    assert own.argmax() == 2 and own[2] > 0.9 and own[0] < 0.3
    assert (filters.wrong < 0.1).all()


def test_more_languages_than_a_mask_has_bits(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * i)}{chr(0x4E01 + 40 * i)}{chr(0x4E02 + 40 * i)} " * 5, f"l{i:02d}") for i in range(70)]
    filters = lang.learn_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.masks.shape[1] == 2
    assert all(filters.predict(t)[0] == c for _, t, c in rows)


def test_prediction_keeps_rows_and_replaces_columns(spark, docs):
    filters = lang.learn_filters(labelled(spark, ("dd",)))
    df = docs().withColumn("score", F.lit("old"))
    said = lang.predict_language(df, filters)
    assert said.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    rows = said.collect()
    assert len(rows) == df.count()
    assert all((r.lang_pred == "und") == (not r.text) for r in rows)
    kept = lang.drop_undetermined(docs(), filters)
    assert kept.columns == docs().columns and kept.count() == 6
    none = lang.learn_filters(docs().where("false"))
    assert none.languages == [] and none.predict("abc") == ("und", 0.0)


def test_few_texts_a_language_are_read(spark):
    rows, _ = lang._sampled(
        labelled(spark).withColumnRenamed("doc_id", "pick").where("lang is not null"), 10
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert all(2 <= n <= 25 for n in counts.values())


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["stone", "river", "Lamp", "over", "and", "the.", "green,"]) + str(rng.randint(0, 3)) * (rng.random() < 0.1) for _ in range(rng.randint(5, 150)))
    bad = lambda: rng.choice([
        lambda: " ".join(w + rng.choice(["%%%", "###"]) for w in good().split()),
        lambda: good().upper() + "!!! " * 9,
        lambda: " ".join(w for w in good().split() for _ in range(9)),
    ])()
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_rules_separate_held_out_texts(judged):
    held = remainder_of_id("doc_id", 5) == 0
    model = q.fit_rules(judged.drop("quality"), judged.where(~held).drop("text"))
    assert 0 < len(model.weights) < 60
    rows = q.score_quality(judged.where(held), model).collect()
    assert "text" not in rows[0].asDict() and len(rows) == judged.where(held).count()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    plan = q.score_quality(judged, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scores_of_odd_texts_and_clashing_names(spark, docs, judged):
    model = q.fit_rules(judged.drop("quality"), judged.drop("text"))
    df = docs().withColumn("score", F.lit(9)).withColumn("s", F.lit(1)).withColumn("words", F.lit(1))
    rows = q.score_quality(df, model).collect()
    assert len(rows) == df.count() and all(r.s == 1 and r.words == 1 and 0 <= r.score <= 1 for r in rows)
    assert q.score_quality(df.where("false"), model).count() == 0
    empty = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(empty) == 1


def test_labels_of_one_class_or_none(spark, judged):
    texts_ = judged.drop("quality")
    one = q.fit_rules(texts_, judged.drop("text").where("quality = 1"))
    assert q.score_quality(texts_, one).where("score < 0.99").count() == 0
    none = q.fit_rules(texts_, judged.drop("text").withColumn("quality", F.lit(None).cast("int")))
    assert {r.score for r in q.score_quality(texts_, none).collect()} == {0.5}


def test_paths_of_a_printed_tree():
    tree = """RegressionTree
  If (feature 0 <= 1.5)
   If (feature 1 <= 2.0)
    Predict: 1.0
   Else (feature 1 > 2.0)
    Predict: 2.0
  Else (feature 0 > 1.5)
   If (feature 0 <= 9.0)
    Predict: 1.0
   Else (feature 0 > 9.0)
    Predict: 3.0
"""
    t = q.Test
    a, b = q.NAMES[:2]
    assert q.tree_paths(tree) == {
        frozenset({t(a, True, 1.5)}), frozenset({t(a, True, 1.5), t(b, True, 2.0)}),
        frozenset({t(a, True, 1.5), t(b, False, 2.0)}), frozenset({t(a, False, 1.5)}),
        frozenset({t(a, False, 1.5), t(a, True, 9.0)}), frozenset({t(a, False, 9.0)}),
    }
