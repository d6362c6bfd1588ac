"""Quality by a sparse ensemble of rules over text statistics.

Boosted trees are grown on statistics of labelled texts. Every path from a root
to a node is a rule, a conjunction of comparisons. A logistic regression with a
lasso penalty weighs the rules and leaves most at zero. The rest is compiled
into one Spark column expression, so scoring runs no Python and no model code.

At most ``max_rows`` labelled texts, chosen by hash, are used for fitting. With
labels of one class only every score is 1 or 0, with none 0.5.

A null text is empty; an empty one has all statistics 0 and is scored as any
other. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import lowest_by_hash, stored

MAX_ROWS = 20_000


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text`` in a struct ``row``, and the statistics in ``s``."""
    rest = [F.col(c) for c in docs.columns if c != text]
    parts = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = parts.withColumn("w", F.filter(F.split("t", r"\s+"), lambda w: w != ""))
    n = F.greatest(F.size("w"), F.lit(1))
    letters = F.regexp_count("t", F.lit(r"\p{L}"))
    raw = parts.select(
        "row",
        F.size("w").alias("words"),
        F.length("t").alias("chars"),
        (F.size(F.array_distinct("w")) / n).alias("distinct_words"),
        (F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1)))) / n).alias("repeats"),
        (F.regexp_count("t", F.lit(r"[^\p{L}\p{N}\s.,;:'\"()-]")) / n).alias("symbols"),
        (F.regexp_count("t", F.lit("[!?]")) / n).alias("exclamations"),
        (F.regexp_count("t", F.lit(r"(?:^|\s)[^\p{L}\p{N}\s]+(?=\s|$)")) / n).alias("bare_marks"),
        (F.regexp_count("t", F.lit(r"\p{Lu}")) / n).alias("capitals"),
        (F.regexp_count("t", F.lit(r"\p{N}")) / n).alias("digits"),
        (letters / n).alias("letters"),
        F.size(F.split("t", "\n")).alias("lines"),
    )
    names = [c for c in raw.columns if c != "row"]
    return raw.select("row", F.struct(*[F.col(c).cast("double").alias(c) for c in names]).alias("s"))


NAMES = [
    "words", "chars", "distinct_words", "repeats", "symbols", "exclamations",
    "bare_marks", "capitals", "digits", "letters", "lines",
]


class Test(NamedTuple):
    name: str
    at_most: bool
    bound: float

    def column(self) -> Column:
        c = F.col("s").getField(self.name)
        return c <= self.bound if self.at_most else c > self.bound


Rule = frozenset[Test]


class RuleModel(NamedTuple):
    intercept: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        # Beyond this the exponential would add nothing.
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-500.0)), F.lit(500.0))))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for test in sorted(rule):
        out = out & test.column()
    return out


def tree_paths(debug_string: str) -> set[Rule]:
    """The path to every node below the root, from a tree model's printed form."""
    rules: set[Rule] = set()
    path: list[tuple[int, Test]] = []
    for line in debug_string.splitlines():
        if not (m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)):
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, Test(NAMES[int(m[2])], m[3] == "<=", float(m[4]))))
        rules.add(narrowed([t for _, t in path]))
    return rules


def narrowed(tests: list[Test]) -> Rule:
    """Without comparisons that another of the same column implies."""
    bounds: dict[tuple[str, bool], float] = {}
    for t in tests:
        old = bounds.get((t.name, t.at_most), t.bound)
        bounds[t.name, t.at_most] = min(old, t.bound) if t.at_most else max(old, t.bound)
    return frozenset(Test(name, at_most, b) for (name, at_most), b in bounds.items())


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = MAX_ROWS,
    trees: int = 8,
    depth: int = 3,
    penalty: float = 0.002,
) -> RuleModel:
    """Fit on ``labels`` (id, label 0 or 1; null labels are left out). Runs jobs."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("label")).dropna()
    wanted = lowest_by_hash(known, "id", max_rows, "label")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted), "id")
    rows = with_statistics(rows.select("label", "text")).select(F.col("row.label").alias("label"), "s")
    rows = stored(rows.repartition(4), "statistics")
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return RuleModel({1.0: 500.0, 0.0: -500.0}.get(next(iter(classes), None), 0.0), [])
    vector = VectorAssembler(inputCols=NAMES, outputCol="features")
    flat = vector.transform(rows.select("label", "s.*")).select("label", "features").cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, minInstancesPerNode=5, maxBins=64).fit(flat)
    flat.unpersist()
    rules = sorted(set().union(*(tree_paths(t.toDebugString) for t in model.trees)), key=lambda r: (len(r), sorted(r)))
    if not rules:
        share = classes[1.0] / sum(classes.values())
        return RuleModel(math.log(share / (1 - share)), [])
    flags = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    fitted = lasso.fit(flags.select("label", "features"))
    weights = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if w]
    return RuleModel(float(fitted.intercept), weights)


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text", keep: float = 0.3) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``score`` and ``predicted`` (replaced if there)."""
    scored = with_statistics(docs.drop("score", "predicted"), text).select("row", model.score().alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= keep).cast("int").alias("predicted"))
