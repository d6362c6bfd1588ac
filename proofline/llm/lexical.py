"""Ranked lexical search of items over all documents, by a dual-tree search.

A document's coordinate for a term is its impact, (10^9 tf) div (1000 tf + 20 m) with
m = 50 + (50 n N) div L; an item's score for it is the sum of weight times impact over
the item's terms, each once. Weights and impacts are not negative, so the sum over the
terms of several items, with the largest impact that several documents have for each
term, is at least the score of any of these documents for any of these items.

Two hierarchies use that. Items are split again and again by the heavy term that parts
them most evenly; a node holds the union of its items' terms. In each task, documents
are laid beside those that serve the same items best, and the nodes of their tree hold
the largest impact per term of eight nodes below. A search walks down both trees at
once. A pair of nodes goes on only if its bound reaches the weakest of its items' k-th
scores so far; all else is pruned whole, and exactly: a bound equal to the k-th score
is followed, as the smaller id may win. K-th scores start from those over a sample of
documents, which no final k-th score can be below.

Spark makes three passes: one over the texts, which counts the items' terms per
document (the only one that reads texts; its table is stored), one over this table for
how many documents hold each term, and the search over it. A task returns k documents an
item at most. Items are taken in blocks whose terms fit a task, each with passes of its
own. Sums are exact: in doubles where no sum can reach 2^53, else in 64-bit integers.

Terms are the runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased. Null and empty texts have none and are never found. Rows with equal item
ids, null among them, are one item with the terms of all. Document ids are integers or
null (a null id comes last among equal scores); every row is a document of its own. Only
ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, give_back

BLOCK_BYTES = 8 << 20  # of item texts at once
SEED_ROWS = 20_000  # documents that give the first k-th scores
CELLS = 2_000_000  # impacts of a document tree at once
FAN = 8

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TABLE).split()


class ItemNode(NamedTuple):
    items: np.ndarray
    terms: np.ndarray
    below: tuple[ItemNode, ...]


def item_tree(items: list[np.ndarray], weights: np.ndarray) -> ItemNode:
    """A tree over items (sorted arrays of terms) whose leaves are single items."""

    def node(which: np.ndarray) -> ItemNode:
        flat = np.concatenate([items[i] for i in which])
        terms, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        if len(which) == 1:
            return ItemNode(which, terms, ())
        parts = np.minimum(counts, len(which) - counts) * (1 + weights[terms])
        best = int(parts.argmax()) if len(parts) else 0
        if len(parts) and parts[best] > 0:
            owner = np.repeat(np.arange(len(which)), [len(items[i]) for i in which])
            holds = np.zeros(len(which), bool)
            holds[owner[at == best]] = True
        else:  # all alike
            holds = np.arange(len(which)) < len(which) // 2
        return ItemNode(which, terms, (node(which[holds]), node(which[~holds])))

    return node(np.arange(len(items)))


def facets(root: ItemNode, most: int = 16) -> list[ItemNode]:
    """The largest nodes of the tree, no more than ``most``, that cover all items."""
    out = [root]
    while len(out) < most:
        at = max(range(len(out)), key=lambda i: len(out[i].items))
        if not out[at].below:
            break
        out += out.pop(at).below
    return out


class Best:
    """The k best documents of every item that one task has seen."""

    def __init__(self, k: int, items: int, floor: np.ndarray):
        self.k = k
        self.need = floor.copy()  # a score below this is of no use
        self.found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items

    def offer(self, item: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        s, n, i = (np.concatenate(x) for x in zip(self.found[item], (scores.astype(np.int64), null, ids)))
        order = np.lexsort((i, n, -s))[: self.k]
        self.found[item] = s[order], n[order], i[order]
        if len(order) == self.k:
            self.need[item] = max(self.need[item], s[order[-1]])


class Index(NamedTuple):
    """What a task needs: the items' tree, weights per term, and counts over all documents."""

    root: ItemNode
    facets: list[ItemNode]
    weights: np.ndarray
    documents: int
    length: int
    k: int
    exact: type  # of the sums


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Of term counts ``tf`` in documents of ``n`` terms."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        part = np.array([50 * x * documents // length for x in n.tolist()], np.int64)
    else:
        part = (50 * n * documents) // max(1, length)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + part))


class DocumentTree:
    """Some documents' impacts, and the largest of every ``FAN`` nodes level by level."""

    def __init__(self, index: Index, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: np.ndarray, null: np.ndarray, ids: np.ndarray):
        self.index = index
        self.here, at = np.unique(terms, return_inverse=True)
        self.weights = index.weights[self.here].astype(index.exact)
        impact = np.zeros((len(ids), len(self.here)), index.exact)
        impact[rows, at] = values
        # Documents that serve the same items best come together, and of these such of like length.
        facet = np.zeros(len(ids), np.int64)
        most = np.full(len(ids), -1, index.exact)
        for f, node in enumerate(index.facets):
            own = self.columns(node.terms)
            sums = impact[:, own] @ self.weights[own]
            facet, most = np.where(sums > most, f, facet), np.maximum(sums, most)
        order = np.lexsort((n, facet))
        self.null, self.ids = null[order], ids[order]
        self.levels = [impact[order]]
        while len(self.levels[-1]) > FAN:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN)))
        self.measured = 0

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """Where those of ``terms`` are that some document here holds."""
        x = np.minimum(np.searchsorted(self.here, terms), len(self.here) - 1)
        return x[self.here[x] == terms]

    def search(self, best: Best) -> int:
        """Offer what may be among the best; returns how many pairs of nodes were measured."""
        top = len(self.levels) - 1
        self._walk(best, self.index.root, top, np.arange(len(self.levels[top])))
        return self.measured

    def _walk(self, best: Best, q: ItemNode, level: int, nodes: np.ndarray) -> None:
        own = self.columns(q.terms)
        bounds = self.levels[level][nodes[:, None], own] @ self.weights[own]
        self.measured += len(nodes)
        alive = (bounds >= best.need[q.items].min()) & (bounds > 0)
        if not alive.any():
            return
        nodes, bounds = nodes[alive], bounds[alive]
        if not level and not q.below:
            best.offer(int(q.items[0]), bounds, self.null[nodes], self.ids[nodes])
            return
        if level > bool(q.below):  # single documents are for single items
            level -= 1
            nodes = nodes[np.argsort(-bounds, kind="stable")]
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < len(self.levels[level])]
        for child in q.below:
            self._walk(best, child, level, nodes)
        if not q.below:  # the best nodes first: they raise the bar for the others
            few = FAN * FAN
            for part in (nodes[:few], nodes[few:]):
                if len(part):
                    self._walk(best, q, level, part)


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of (id, text) for documents with a term: how many terms it has, and the
    vocabulary's terms among them with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = shared.value.get
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for begin in range(0, batch.num_rows, 256):
                part = column.slice(begin, 256)
                flat, sizes, n = [], [], []
                for raw in part:
                    words = terms_of(raw.as_py() or b"")
                    found = [i for i in map(get, words) if i is not None]
                    n.append(len(words))
                    sizes.append(len(found))
                    flat += found
                row = np.repeat(np.arange(len(n)), sizes)
                order = np.lexsort((np.array(flat, np.int32), row))
                both = np.stack([row, np.array(flat, np.int64)])[:, order]
                new = np.ones(both.shape[1], bool)
                new[1:] = (both[:, 1:] != both[:, :-1]).any(0)
                at = np.flatnonzero(new)
                tfs = np.diff(np.append(at, both.shape[1]))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(both[0, at], minlength=len(n)))]).astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, 256), pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(both[1, at], pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                    ],
                    names=["id", "n", "terms", "tfs"],
                )
                yield out.filter(pa.array(np.array(n) > 0))
        give_back()

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


def candidates(vectors: DataFrame, index: Index, floor: np.ndarray) -> DataFrame:
    """(item, id, score): of each task the k best documents of every item, if they reach ``floor``."""
    shared = vectors.sparkSession.sparkContext.broadcast((index, floor))

    def run(batches) -> Iterator[pa.RecordBatch]:
        index, floor = shared.value
        best = Best(index.k, len(floor), floor)
        for batch in batches:
            ids = batch.column("id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            n = batch.column("n").to_numpy()
            terms = batch.column("terms").flatten().to_numpy()
            tfs = batch.column("tfs").flatten().to_numpy()
            sizes = batch.column("terms").value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            a = 0
            while a < batch.num_rows:
                # As many documents as keep the tree's table of impacts within bounds.
                lo = ends[a] - sizes[a]
                b = min(batch.num_rows, a + 1024)
                while b > a + 1 and (b - a) * len(np.unique(terms[lo : ends[b - 1]])) > CELLS:
                    b = a + max(1, (b - a) // 2)
                part = slice(lo, ends[b - 1])
                rows = np.repeat(np.arange(b - a), sizes[a:b])
                values = impacts(tfs[part], n[a:b][rows], index.documents, index.length)
                DocumentTree(index, rows, terms[part], values, n[a:b], null[a:b], ids[a:b]).search(best)
                a = b
        for i, (s, nul, found) in enumerate(best.found):
            if len(s):
                item = pa.array(np.full(len(s), i), pa.int32())
                yield pa.RecordBatch.from_arrays([item, pa.array(found, pa.int64(), mask=nul), pa.array(s)], names=["item", "id", "score"])
        give_back()

    return vectors.where(F.size("terms") > 0).mapInArrow(run, "item int, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Lists of (item id, set of its terms), each of ``most`` bytes of text or a little more."""
    sized = items.groupBy("item").agg(F.sum(F.octet_length("text")).alias("bytes"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // most))
    for p in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p) if parts > 1 else items
        block: dict = {}
        for r in mine.toLocalIterator():
            block.setdefault(r["item"], set()).update(terms_of((r["text"] or "").encode("utf-8", "surrogatepass")))
        block = [(i, t) for i, t in block.items() if t]
        if block:
            yield sorted(block, key=lambda x: (x[0] is None, x[0]))


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """(item_id, rank, id, score): each item's ``k`` documents of the highest scores above 0."""
    docs = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    spark, out = docs.sparkSession, None
    kind = items.schema["item"].dataType.simpleString()
    scratch = Scratch(spark, "lexical")
    for block in _item_blocks(items, block_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(t for _, t in block))))}
        vectors = scratch.keep(counted(docs, vocabulary))
        documents, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[held["term"].to_numpy()] = held["df"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        terms = [np.array(sorted(vocabulary[t] for t in own), np.int32) for _, own in block]
        root = item_tree(terms, weights)
        highest = int(weights[root.terms].sum()) * 500_000  # no impact is above that
        index = Index(root, facets(root), weights, documents, length, k, np.float64 if highest < 1 << 53 else np.int64)
        floor = np.ones(len(block), np.int64)
        if documents > 2 * seed_rows:
            part = vectors.where(F.pmod(F.xxhash64("id", "n"), F.lit(documents // seed_rows)) == 0)
            for r in _ranked(candidates(part, index, floor), k).where(F.col("rank") == k).select("item", "score").collect():
                floor[r["item"]] = r["score"]
        found = _ranked(candidates(vectors, index, floor), k)
        named = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {kind}")
        # A row per item of a block.
        found = found.join(F.broadcast(named), "item")
        found = found.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {kind}, rank int, id bigint, score bigint").toDF(item_id, "rank", id, "score")
    return out
