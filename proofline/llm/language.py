"""Language identification with one bit-sliced Bloom filter for all languages.

A cell of the filter is not a bit but a mask with a bit per language. The masks
of an n-gram's cells, and-ed, say at once which languages have it. A text's
n-grams are looked up, the bits counted per language, and each count corrected
for the false positives its language's filter is known to give: of ``n``
n-grams, ``c`` hits and a false-positive rate ``f``, the share is
``(c / n - f) / (1 - f)``. The largest share decides, and is the score.

What a filter holds is learned from labelled texts: the n-grams that make up at
least ``min_share`` of a language's and at least ``relative`` times as much as
of the language where they are most frequent, so mislabelled texts do no harm.
At most ``per_language`` texts a language are read for this, chosen by hash.

Null texts and texts without a letter are ``und`` with score 0, as is any text
if no language could be learned. A text with letters but no known n-gram gets
the first language by name, with score 0. Ties go to the first by name. Texts
are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from proofline.llm.common import give_back

SIZES = (3, 4)
CELLS = 1 << 20
PROBES = 3
PER_LANGUAGE = 4000
UNDETERMINED = "und"
_BITS = 62  # languages per slice, so a mask is never negative

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_runs(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others one 0, at the ends too."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter()[codes]
    if not letters.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letters, codes, 0).astype(np.uint64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    runs = codes[keep]
    return np.concatenate([[np.uint64(0)], runs, [np.uint64(0)]] if runs[-1] else [[np.uint64(0)], runs]).astype(np.uint64)


def gram_codes(runs: np.ndarray, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """A 64-bit code for every n-gram."""
    out = []
    for n in sizes:
        if len(runs) < n:
            continue
        code = np.full(len(runs) - n + 1, n, np.uint64)
        for i in range(n):
            code = (code ^ runs[i : len(runs) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        out.append(code)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cells_of(codes: np.ndarray, cells: int, probes: int) -> Iterator[np.ndarray]:
    step = (codes >> np.uint64(32)) | np.uint64(1)
    for i in range(probes):
        yield ((codes + np.uint64(i) * step) & np.uint64(cells - 1)).astype(np.int64)


class Filters(NamedTuple):
    """``masks``: cells x slices; ``wrong``: false-positive rate per language."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray
    probes: int
    sizes: tuple[int, ...]

    def shares(self, text: str | None) -> np.ndarray | None:
        """Corrected share of n-grams per language; None if there is no letter."""
        runs = letter_runs(text)
        if not len(runs):
            return None
        codes = gram_codes(runs, self.sizes)
        n = max(1, len(codes))
        found = None
        for at in cells_of(codes, len(self.masks), self.probes):
            found = self.masks[at] if found is None else found & self.masks[at]
        counts = np.array([
            np.count_nonzero(found[:, i // _BITS] & (1 << (i % _BITS))) for i in range(len(self.languages))
        ])
        return np.clip((counts / n - self.wrong) / (1 - self.wrong), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text) if self.languages else None
        if shares is None:
            return UNDETERMINED, 0.0
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def _sampled(labelled: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` rows of every language at most; languages are few."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, per_language / n).otherwise(share)
    draw = F.pmod(F.xxhash64("pick"), F.lit(1 << 20)) / float(1 << 20)
    return labelled.where(draw < share), sorted(counts)


def _count_grams(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(lang, code, n), summed per batch."""
    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            by_lang: dict[str, list[np.ndarray]] = {}
            for i, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(gram_codes(letter_runs(texts[i].as_py()), sizes))
            for lang, parts in by_lang.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(codes), pa.string()), "code": codes.view(np.int64), "n": n.astype(np.int64)}
                )
        give_back()

    return rows.select("lang", "text").mapInArrow(run, "lang string, code bigint, n bigint")


def learn_filters(
    labelled: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    min_share: float = 2e-6,
    relative: float = 0.2,
    cells: int = CELLS,
    probes: int = PROBES,
    sizes: tuple[int, ...] = SIZES,
) -> Filters:
    """Runs jobs; the driver gets one mask per cell, whose number is fixed."""
    rows = labelled.select(F.col(id).alias("pick"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows, languages = _sampled(rows.where("lang is not null"), per_language)
    slices = max(1, -(-len(languages) // _BITS))
    masks = np.zeros((cells, slices), np.int64)
    if languages:
        spark = labelled.sparkSession
        grams = _count_grams(rows.where("text is not null"), sizes).groupBy("lang", "code").agg(F.sum("n").alias("n"))
        totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
        number = spark.createDataFrame(list(enumerate(languages)), "number int, lang string")
        shares = grams.join(F.broadcast(totals.join(number, "lang")), "lang").select(
            "code", "number", (F.col("n") / F.col("total")).alias("share")
        )
        # Languages are few, so an n-gram's rows are as well.
        most = shares.groupBy("code").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "share")).alias("in"))
        kept = most.select("code", "most", F.explode("in").alias("l")).where(
            (F.col("l.share") >= min_share) & (F.col("l.share") >= relative * F.col("most"))
        )
        step = F.shiftrightunsigned("code", 32).bitwiseOR(1)
        # Sums modulo the number of cells need the low bits only.
        low = lambda c: c.bitwiseAND(cells - 1)
        at = F.array(*[low(low(F.col("code")) + i * low(step)) for i in range(probes)])
        bit = F.expr(f"shiftleft(1L, cast(l.number % {_BITS} as int))")
        sums = (
            kept.select(F.explode(F.array_distinct(at)).alias("cell"), F.expr(f"l.number div {_BITS}").alias("slice"), bit.alias("bit"))
            .groupBy("cell", "slice")
            .agg(F.bit_or("bit").alias("mask"))
            .toArrow()
        )
        masks[sums["cell"].to_numpy(), sums["slice"].to_numpy()] = sums["mask"].to_numpy()
    load = np.array([np.count_nonzero(masks[:, i // _BITS] & (1 << (i % _BITS))) / cells for i in range(len(languages))])
    if slices == 1 and len(languages) <= 7:
        masks = masks.astype(np.int8)  # fits a processor's cache
    return Filters(languages, masks, load**probes, probes, sizes)


def predict_language(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (replaced if they are there)."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast(filters)
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        filters = model.value
        for batch in batches:
            texts = batch.column(at)
            said = [filters.predict(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def drop_undetermined(docs: DataFrame, filters: Filters, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows whose language can be told, at ``min_score`` or more, with their own columns."""
    at = docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        filters = model.value
        for batch in batches:
            texts = batch.column(at)
            said = (filters.predict(texts[i].as_py()) for i in range(len(texts)))
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in said], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


