"""Benchmark decontamination by Wu-Manber search over words.

Benchmark items are cut into windows of 13 consecutive words (an item of fewer
words is one window). The windows of one length form a table: for every block
of two words, how far the end of a window may lie ahead (``shift``), and for
blocks that end a window, the windows that end so. The search looks at the
block before a position, skips as far as its shift allows, and only where the
shift is 0 compares the windows of that block with the text word by word.

Documents are streamed past the tables, one text at a time, without a shuffle.
The benchmark is read in blocks of at most ``block_bytes`` of text; one block's
tables are broadcast at a time. With several blocks, the hits of a document in
all of them are merged by the document's id and text.

Words: A-Z lower-cased, then runs of ASCII letters and digits and anything
beyond ASCII. Nulls and texts without words have no words and no hits; an item
without words has no windows. Items that share an id count once; an item with a
null id marks words but is not counted or listed. Every row of ``docs`` gives
one row, repeated ones too. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import stored

WINDOW = 13
BLOCK_BYTES = 8_000_000

_TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split(b" ") if text else []


def split_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class WindowTable:
    """Shift and suffix tables of the windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], set]):
        self.length, self.block = length, min(2, length)
        self.mask = (1 << max(10, (8 * length * len(windows)).bit_length())) - 1
        most = length - self.block + 1
        self.shift = np.full(self.mask + 1, most, np.int16)
        self.ends: dict[int, list[tuple[tuple[int, ...], set]]] = defaultdict(list)
        for words, items in windows.items():
            codes = self.codes(np.array(words, np.int64))
            ahead = np.arange(len(codes))[::-1].astype(np.int16)
            np.minimum.at(self.shift, codes, ahead)
            self.ends[int(codes[-1])].append((words, items))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A code for the block that ends at each position from the first full one on."""
        if self.block == 1:
            return (ids * 2654435761) & self.mask
        return ((ids[:-1] * 2654435761) ^ (ids[1:] * 40503)) & self.mask

    def search(self, ids: list[int], array: np.ndarray) -> Iterator[tuple[int, set]]:
        """(end, items) of every window that occurs."""
        length, first = self.length, self.block - 1
        if len(ids) < length:
            return
        codes = self.codes(array)
        shifts = self.shift[codes].tolist()
        at, n = length - 1, len(ids)
        while at < n:
            shift = shifts[at - first]
            if shift:
                at += shift
                continue
            for words, items in self.ends.get(int(codes[at - first]), ()):
                if tuple(ids[at - length + 1 : at + 1]) == words:
                    yield at, items
            at += 1


class Searcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: Iterable[tuple[object, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1) if length else ():
                by_length[length][tuple(ids[i : i + length])].add(item)
        self.tables = [WindowTable(n, dict(w)) for n, w in sorted(by_length.items())]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit stretches (start, end) joined and in order, and the items."""
        words = split_words(text)
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        array = np.array(ids, np.int64)
        found, items = [], set()
        for table in self.tables:
            for end, which in table.search(ids, array):
                found.append((end - table.length + 1, end + 1))
                items |= which
        return len(words), joined(found), items


def joined(stretches: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(id).cast("string"), text)
    for item, words in rows.toLocalIterator():
        if block and size + len(words) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


_HITS = "id {}, copy string, n_words bigint, hits array<struct<s: int, e: int>>, items array<string>"


def _search(docs: DataFrame, block: list[tuple], window: int, keyed: bool) -> DataFrame:
    """A row per document: words, hit stretches and items of this block."""
    tables = docs.sparkSession.sparkContext.broadcast(Searcher(block, window))
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        searcher = tables.value
        for batch in batches:
            texts = batch.column(1)
            n, hits, items = [], [], []
            for i in range(len(texts)):
                words, found, which = searcher.hits(texts[i].as_py())
                n.append(words)
                hits.append([{"s": s, "e": e} for s, e in found])
                items.append(sorted(x for x in which if x is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))],
                names=["id", "copy", "n_words", "hits", "items"],
            )

    copy = F.sha2("text", 256) if keyed else F.lit(None).cast("string")
    return docs.select("id", "text", copy.alias("copy")).mapInArrow(
        run, _HITS.format(docs.schema["id"].dataType.simpleString())
    )


def _covered(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + h["e"] - h["s"])


def _united(hits: Column) -> Column:
    """Words covered by stretches of several blocks, which may overlap."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        F.array_sort(hits),
        start,
        lambda a, h: F.struct(
            (a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], a["to"]))).cast("bigint").alias("n"),
            F.greatest(a["to"], h["e"]).alias("to"),
        ),
        lambda a: a["n"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated.

    Contaminated: some word is hit, and at least a twentieth of the words are.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        rows = _search(docs, block, window, keyed=False)
        rows = rows.select("id", "n_words", _covered(F.col("hits")).alias("n_hit"), "items")
    else:
        parts, number = None, 0
        while block is not None:
            part = stored(_search(docs, block, window, keyed=True), "hits")
            parts = part if parts is None else parts.unionByName(part)
            block, after, number = after, next(blocks, None), number + 1
        # Equal documents have equal hits: they are one group, and listed as often as they occur.
        rows = (
            parts.groupBy("id", "copy", "n_words")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            )
            .withColumn("n_hit", _united(F.col("hits")))
            .withColumn("copies", F.explode(F.sequence(F.lit(1), F.expr(f"cast(rows div {number} as int)"))))
            .select("id", "n_words", "n_hit", "items")
        )
    return rows.select(
        F.col("id").alias(id),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    ``options`` as for ``contamination`` except ``id``. Rows are told apart by
    their text alone, so they need no id, and only texts that are hit are kept
    in memory of a task, one at a time.
    """
    text = options.pop("text", "text")
    window = options.pop("window", WINDOW)
    size = options.pop("block_bytes", BLOCK_BYTES)
    names = {k: options.pop(k, v) for k, v in (("item", "item_id"), ("item_text", "text"))}
    if options:
        raise TypeError(f"unknown options {sorted(options)}")
    blocks = _blocks(benchmark, names["item"], names["item_text"], size)
    block, after = next(blocks), next(blocks, None)
    if after is not None:
        marked = contamination(docs.select(F.lit(0).alias("id"), F.col(text).alias("text")).withColumn("id", F.sha2("text", 256)).distinct(),
                               benchmark, "id", "text", names["item"], names["item_text"], window, size)
        bad = marked.where("contaminated").select(F.col("id").alias("__sha"))
        # Null texts have no digest and stay.
        return docs.join(bad, F.sha2(F.col(text), 256) == F.col("__sha"), "left_anti")
    tables = docs.sparkSession.sparkContext.broadcast(Searcher(block, window))
    at = docs.columns.index(text)

    def run(batches):
        searcher = tables.value
        for batch in batches:
            texts, keep = batch.column(at), []
            for i in range(len(texts)):
                n, hits, _ = searcher.hits(texts[i].as_py())
                hit = sum(e - s for s, e in hits)
                keep.append(not (hit and 20 * hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
