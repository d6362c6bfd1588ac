"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A document is the weighted set of its shingles of five words (a shorter one is
one shingle); a shingle that occurs n times weighs 1 + ln n. Each shingle sends
arrivals, at the times of a Poisson process with its weight as rate, to random
registers of the signature, and a register keeps the shingle that came first.
The chance that two documents agree in a register is their probability Jaccard
similarity, which for equal weights is the Jaccard similarity. A shingle stops
sending once its next arrival is later than the latest of all registers.

Five registers make a band. Documents that share a band are candidates, and a
candidate pair is a link if the Jaccard similarity of its shingle sets, counted
exactly, is ``threshold`` or more. A document that repeats a shingle has thirty
bands by these weights and thirty more by weights of one, which for the others
are the same bands. So each pair has thirty bands by the similarity that is
verified, which miss a pair of similarity 0.8 once in 150,000, however often
either repeats a passage. Classes are the connected components of the links.

Documents of equal words are one node from the start. In a bucket of a band
nodes are first compared with the hub, the one of them that shares most bands
with other nodes, so a bucket of thousands of copies of one text costs thousands
of comparisons and not their square. Only nodes that share a hub, in whichever
buckets, and are then still in different classes are compared with each other, and
of these only pairs that can be links by the shingles in which they differ from the
hub, which that comparison gives: two texts
that differ from it in i and j shingles, m of them the same, differ from each
other in i + j - 2m. So a pair is a link only if m is large enough, and then both
hold one of the rarest of these shingles, so early that as many as needed can
follow (a prefix filter with places, over differences instead of sets). No link
is lost; a thousand texts that are almost, but not quite, similar enough cost few
comparisons. Where links themselves are many, in a crowd whose hub is in none of
them, so are these pairs.

Words: A-Z lower-cased, runs of ASCII letters and digits and anything beyond
ASCII. Null texts, and texts without words, are in no class but their own. Null
and repeated ids are allowed. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import give_back, stored
from proofline.llm.components import stars
from proofline.llm.exact_dedup import in_filter, key_filter

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
CHUNK = 250_000  # bytes of text worked on at once, or one longer text

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in range(256)])
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle in order, and the hash of each text's words.

    A shingle's hash is that of its bytes, from sums over the whole chunk, so no
    step goes word by word. A text without words has hash 0 and no shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    # A zero byte before and after each text ends its words.
    data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
    is_word = _WORD[data]
    owner_ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]  # words, each with one byte after it
    flat = np.where(is_word, _LOWER[data], 0)[keep]
    place = np.flatnonzero(keep)
    first = np.flatnonzero((flat != 0) & np.concatenate([[True], flat[:-1] == 0])) if len(flat) else np.zeros(0, np.int64)
    last = np.flatnonzero(flat == 0)  # one past each word
    owner = np.searchsorted(owner_ends, place[first], side="left")
    up, down = _power_tables(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((flat.astype(_U) + _U(1)) * up[: len(flat)], dtype=_U)])
    count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(count)])[:-1].astype(np.int64)
    number = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    who = np.repeat(np.arange(len(texts)), number)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(number) - number, number)
    a = start[who] + offset
    b = np.minimum(a + width, start[who] + count[who]) - 1
    hashes = mix((sums[last[b]] - sums[first[a]]) * down[first[a]]) if len(who) else np.zeros(0, _U)
    whole = np.zeros(len(texts), _U)
    some = np.flatnonzero(count)
    if len(some):
        a, b = start[some], start[some] + count[some] - 1
        whole[some] = mix((sums[last[b]] - sums[first[a]]) * down[first[a]]) | _U(1)
    return who, hashes, whole


def weighed(who: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text, and how often each occurs."""
    order = np.lexsort((hashes, who))
    who, hashes = who[order], hashes[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return who[at], hashes[at], np.diff(np.append(at, len(who)))


def signatures(who: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle that first arrived at each register.

    All shingles' first arrivals are dealt at once, then the second ones of those
    that can still come early enough, and so on.
    """
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, _U)
    time = np.zeros(len(who))
    turn = 0
    while len(who):
        turn += 1
        r = mix(hashes + _U((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(r >> _U(11)).astype(float) * 2.0**-53) / weights
        cell = who * registers + (mix(r) % _U(registers)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        winner[cell[won]] = hashes[won]
        latest = first.reshape(texts, registers).max(1)
        go = time < latest[who]
        who, hashes, weights, time = who[go], hashes[go], weights[go], time[go]
    return winner.reshape(texts, registers)


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands."""
    out = np.empty((len(winner), bands), _U)
    for b in range(bands):
        h = np.full(len(winner), b + 1, _U)
        for r in range(rows):
            h = mix(h ^ winner[:, b * rows + r]) + _U(r + 1)
        out[:, b] = h
    return out


def all_bands(who: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, bands: int, rows: int) -> list[np.ndarray]:
    """The distinct bands of each text: by weights, and by weights of one where these differ."""
    found = band_keys(signatures(who, hashes, 1 + np.log(counts), texts, bands * rows), bands, rows).view(np.int64)
    out = list(found)
    again = np.unique(who[counts > 1])
    if len(again):
        mine = np.isin(who, again)
        at = np.searchsorted(again, who[mine])
        alike = signatures(at, hashes[mine], np.ones(len(at)), len(again), bands * rows)
        for i, plain in zip(again, band_keys(alike, bands, rows).view(np.int64)):
            out[i] = np.unique(np.concatenate([found[i], plain]))
    return out


def chunks(column, size: int = CHUNK) -> Iterator[tuple[int, list]]:
    """Stretches of a text column of about ``size`` characters, with where they begin."""
    begin, some, chars = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py()
        some.append(text)
        chars += len(text or "")
        if chars >= size:
            yield begin, some
            begin, some, chars = i + 1, [], 0
    if some:
        yield begin, some


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, sha, words, size, bands) of (id, sha, text); ``bands`` is null without words.

    ``words`` identifies the sequence of words: two hashes over it.
    """

    def run(batches):
        for batch in batches:
            words, sizes, keys = [], [], []
            for _, texts in chunks(batch.column(2)):
                who, hashes, whole = shingles(texts)
                # A second, independent hash: over the shingles with their places.
                place = np.arange(len(who)) - np.searchsorted(who, who)
                other = np.zeros(len(texts), _U)
                np.add.at(other, who, mix(hashes ^ mix(place.astype(_U) + _U(7))))
                words += [a.tobytes() + b.tobytes() if a else None for a, b in zip(whole, other)]
                who, hashes, counts = weighed(who, hashes)
                sizes += np.bincount(who, minlength=len(texts)).tolist()
                found = all_bands(who, hashes, counts, len(texts), bands, rows)
                keys += [k if w else None for k, w in zip(found, whole)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "sha", "words", "size", "bands"],
            )
        give_back()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "sha", "text").mapInArrow(run, f"id {kind}, sha binary, words binary, size int, bands array<bigint>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with the texts a and b of their nodes as last columns."""
    return pairs.join(texts.select(F.col("words").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("words").alias("v"), F.col("text").alias("b")), "v"
    ).select(*pairs.columns, "a", "b")


def _side_by_side(a: pa.Array, b: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of pairs of texts: how many pairs, the distinct shingles of each text,
    and in order of the pairs their shingles: pair, hash, whether the next one is the same
    of the other text."""
    some: list = []
    size = 0
    for i in range(len(a)):
        some += [a[i].as_py(), b[i].as_py()]
        size += len(some[-1]) + len(some[-2])
        if size >= CHUNK or i == len(a) - 1:
            who, hashes, _ = shingles(some)
            who, hashes, _ = weighed(who, hashes)
            each = np.bincount(who, minlength=len(some))
            # A shingle of both texts of a pair is there twice.
            pair = who // 2
            order = np.lexsort((hashes, pair))
            pair, hashes = pair[order], hashes[order]
            twice = np.zeros(len(pair), bool)
            twice[:-1] = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
            yield len(some) // 2, each, pair, hashes, twice
            some, size = [], 0


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with ``shared``, how many shingles both have, and ``apart``, the
    hashes of those that one of the two has."""
    columns = pairs.columns

    def run(batches):
        for batch in batches:
            begin = 0
            for n, _, pair, hashes, twice in _side_by_side(batch.column(len(columns)), batch.column(len(columns) + 1)):
                alone = ~twice
                alone[1:] &= ~twice[:-1]
                shared = pa.array(np.bincount(pair[twice], minlength=n), pa.int32())
                ends = np.cumsum(np.bincount(pair[alone], minlength=n))
                apart = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends), pa.int32()), pa.array(hashes[alone].view(np.int64), pa.int64())
                )
                same = batch.slice(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [*[same.column(i) for i in range(len(columns))], shared, apart], names=[*columns, "shared", "apart"]
                )
                begin += n
        give_back()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return _with_texts(pairs, texts).mapInArrow(run, f"{kinds}, shared int, apart array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (u, v, ...) with ``apart``, and whether their shingle sets are ``similar`` enough."""
    union = F.col("shared") + F.size("apart")
    return differences(pairs, texts).withColumn("similar", F.col("shared") >= threshold * union - 1e-9).drop("shared")


def _close(a: str, b: str, threshold: float) -> Column:
    """Sets so different in size cannot be similar."""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members (words, hub, ...) beside hubs that have more than one class beside them, with
    their classes, of ``groups`` (u, v) from ``stars``."""
    placed = members.join(groups.select(F.col("u").alias("words"), F.col("v").alias("class")), "words", "left")
    placed = placed.withColumn("class", F.coalesce("class", "words"))
    per_hub = placed.groupBy("hub").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    # Stored, so that the members of a hot hub can be split.
    mixed = stored(per_hub.where("a <> b").select("hub"), "mixed")
    return stored(placed.join(mixed, "hub", "left_semi"), "open")


def _cross_pairs(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of different classes beside one hub that can be links, each once, with
    their classes cu and cv. ``members`` (words, hub, size, class) come once beside a hub, and
    may bring ``apart``, how they differ from it.

    A node differs from its hub in ``d`` shingles, and of these ``e`` more than its share of
    those in which two texts that are linked may differ. A link then has (e + e') / 2 or more
    of these shingles in common, which is above 0, as both nodes would be linked to the hub
    otherwise. In order of rarity, the first they have in common has as many after it in both.
    """
    share = (1 - threshold) / (1 + threshold)
    apart = members.withColumnsRenamed({"words": "u", "hub": "v"})
    if "apart" not in members.columns:
        apart = stored(differences(apart, texts), "apart")
    apart = apart.select("u", "v", "size", "class", "apart", F.size("apart").alias("d"))
    apart = apart.withColumn("e", F.col("d") - share * F.col("size"))
    each = apart.select("u", "v", F.explode("apart").alias("shingle"))
    # Those of one node alone are the first in order and meet nothing: they only take places.
    often = each.groupBy("v", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = F.sort_array(F.collect_list(F.struct("n", "shingle")))
    common = each.join(often, ["v", "shingle"]).groupBy("u", "v").agg(order.alias("common"))
    # Stored, so that the nodes beside a hot hub can be split.
    least = stored(apart.groupBy("v").agg(F.min("e").alias("least")), "least")

    def last(overlap: Column) -> Column:
        """The last place the first of so many can have."""
        return F.col("d") - F.greatest(F.lit(1), F.ceil(overlap - 1e-6))

    # Of a pair, one has the smaller e; the other may be with any.
    ends = apart.drop("apart").join(least, "v").withColumn("as_first", last(F.col("e"))).withColumn(
        "as_second", last((F.col("e") + F.col("least")) / 2)
    )
    rows = ends.join(common, ["u", "v"]).select("*", F.posexplode("common").alias("i", "at"))
    rows = rows.withColumn("place", F.col("i") + F.col("d") - F.size("common")).where("place <= as_second")
    rows = rows.withColumn("after", F.col("d") - F.col("place"))
    rows = stored(rows.select("u", "v", "at.shingle", "size", "class", "e", "after", (F.col("place") <= F.col("as_first")).alias("first")), "rare")
    names = {"u": "u", "size": "s", "class": "c", "e": "e", "after": "after"}
    a, b = (
        rows.where(some).select("v", "shingle", *[F.col(x).alias(f"{y}{i}") for x, y in names.items()])
        for i, some in ((1, F.col("first")), (2, F.lit(True)))
    )
    meet = (a["v"] == b["v"]) & (a["shingle"] == b["shingle"]) & (F.col("c1") != F.col("c2"))
    meet &= (F.col("e1") < F.col("e2")) | ((F.col("e1") == F.col("e2")) & (F.col("u1") < F.col("u2")))
    enough = 2 * F.least("after1", "after2") >= F.col("e1") + F.col("e2") - 1e-6
    met = a.join(b, meet & _close("s1", "s2", threshold) & enough)
    ends = [F.struct(F.col(f"u{i}").alias("node"), F.col(f"c{i}").alias("class")) for i in (1, 2)]
    pairs = met.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    return pairs.select(
        F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.class").alias("cu"), F.col("b.class").alias("cv")
    ).distinct()


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(words, text) for ``nodes`` (words, sha), by a filter before the shuffle."""
    words, bits = key_filter(nodes, F.xxhash64("sha"))
    maybe = docs.where(in_filter(F.xxhash64("sha"), words.scalar(), bits)).groupBy("sha").agg(F.max("text").alias("text"))
    return maybe.join(nodes, "sha").select("words", "text")


def _meeting(own: DataFrame) -> DataFrame:
    """(words, size, sha, keys, meets), stored, of the nodes that share bands with others: which
    bands, and how often in all."""
    nodes = own.groupBy("words").agg(F.max("size").alias("size"), F.max("bands").alias("bands"), F.min("sha").alias("sha"))
    nodes = stored(nodes, "nodes")
    keys = nodes.select("words", F.explode("bands").alias("key"))
    buckets = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    # Sizes and hashes are kept out of the bands' rows.
    parts = keys.join(buckets, "key").unionByName(nodes.select("words", "size", "sha"), allowMissingColumns=True)
    of = parts.groupBy("words").agg(
        F.max("size").alias("size"), F.max("sha").alias("sha"), F.collect_list("key").alias("keys"), F.sum("n").alias("meets")
    )
    return stored(of.where("meets is not null"), "meeting")


def _beside_hubs(meeting: DataFrame) -> DataFrame:
    """(u, v, size), stored: each node u once beside each hub v of its buckets."""
    members = meeting.select("words", "size", "meets", F.explode("keys").alias("key"))
    # The text that copies were made from shares more bands with them than they share
    # with each other, so the node that meets most others is a bucket's hub.
    hubs = members.groupBy("key").agg(F.max(F.struct("meets", "words")).alias("hub")).select("key", "hub.words")
    beside = members.withColumnRenamed("words", "u").join(hubs.withColumnRenamed("words", "v"), "key").where("u <> v")
    return stored(beside.select("u", "v", "size").repartition("u").distinct(), "beside")


def _classes(links: DataFrame, a: str, b: str) -> DataFrame:
    return stars(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))


def near_classes(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """A row per row of ``docs``, stored: id, sha (of the text, null counting as empty),
    class_id (the smallest id of the class), group_size, kept (one row of each class)."""
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("sha", F.unhex(F.sha2("text", 256)))
    sig = stored(signed(docs, bands, rows), "signatures")
    meeting = _meeting(sig.where("words is not null"))
    texts = stored(_texts_of(docs, meeting.select("words", "sha")), "texts")
    # How a node differs from its hub tells whether they are linked, and later which others it can be linked to.
    beside = stored(verified(_beside_hubs(meeting), texts, threshold), "beside")
    groups = _classes(beside.where("similar"), "u", "v")
    open_ = _mixed(beside.drop("similar").withColumnsRenamed({"u": "words", "v": "hub"}), groups)
    if not open_.isEmpty():
        # These link classes, which are the smallest nodes of the stars so far.
        more = verified(_cross_pairs(open_, texts, threshold), texts, threshold).where("similar")
        more = _classes(stored(more.select("cu", "cv"), "links"), "cu", "cv")
        into = more.select(F.col("u").alias("v"), F.col("v").alias("into"))
        groups = groups.join(into, "v", "left").select("u", F.coalesce("into", "v").alias("v")).unionByName(more)

    # Rows by id and text; alike ones are counted together until the end.
    listed = sig.groupBy("id", "sha", "words").agg(F.count(F.lit(1)).alias("n"))
    listed = listed.join(groups.select(F.col("u").alias("words"), F.col("v").alias("class")), "words", "left").withColumn(
        "class", F.coalesce("class", "words", F.concat(F.encode(F.coalesce(F.col("id").cast("string"), F.lit("null")), "utf-8"), F.col("sha")))
    )
    # Rows without words are classes of one row each, alike or not.
    alone = F.col("words").isNull()
    listed = stored(listed.select("id", "sha", "class", "n", alone.alias("alone")), "listed")
    sums = stored(
        listed.where("not alone").groupBy("class").agg(F.min(F.struct("id", "sha")).alias("first"), F.sum("n").alias("group_size")), "sums"
    )
    joined = listed.join(sums, "class", "left").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return joined.select(
        "id",
        "sha",
        F.when(F.col("alone"), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(F.col("alone"), 1).otherwise(F.col("group_size")).cast("bigint").alias("group_size"),
        (
            F.col("alone") | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha")) & (F.col("i") == 1))
        ).alias("kept"),
    )


def mark_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, class_id, group_size, kept for every row; ``options`` as for ``near_classes``."""
    return near_classes(docs, id, text, **options).drop("sha").withColumnRenamed("id", id)


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns.

    Columns must be orderable (no maps): of rows alike in id and text the last in order stays.
    """
    marks = near_classes(docs, id, text, **options).where("group_size > 1")
    marks = stored(marks.groupBy("id", "sha").agg(F.max("kept").alias("kept")), "marks")
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    words, bits = key_filter(marks, F.xxhash64("sha"))
    maybe = in_filter(F.xxhash64(sha), words.scalar(), bits)
    packed = docs.where(maybe).select(F.struct("*").alias("row"), F.col(id).alias("id"), sha.alias("sha"))
    mark = marks.select(F.col("id").alias("mark_id"), F.col("sha").alias("mark_sha"), "kept")
    found = packed.join(mark, F.expr("id <=> mark_id and sha = mark_sha"), "left")
    others = found.where("kept is null").select("row.*")
    best = found.where("kept").groupBy("id", "sha").agg(F.max("row").alias("row")).select("row.*")
    return docs.where(~maybe).unionByName(others).unionByName(best)
