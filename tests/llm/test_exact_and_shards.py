import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from proofline.llm import exact_dedup, sharding


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_marks_match_brute_force(docs, bits):
    df = docs()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    got = exact_dedup.mark_repeats(df, max_bits=bits).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, sha(t)) for i, t in rows)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == max(known, default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({s: 1 for s in groups})


def test_kept_rows_keep_their_columns(docs):
    df = docs().withColumn("kept", F.lit(7)).withColumn("text_sha256", F.lit("x"))
    got = exact_dedup.drop_repeats(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == 4
    assert {(r.doc_id, r.source) for r in rows} == {(2, "b"), (4, None), (None, "a"), (5, "a")} or len(
        {r.text or "" for r in rows}
    ) == 4
    assert {r.doc_id for r in rows if r.text == "alpha beta gamma"} == {2}


def test_empty_table(docs):
    none = docs().where("false")
    assert exact_dedup.mark_repeats(none).count() == 0
    assert exact_dedup.drop_repeats(none).count() == 0
    assert sharding.shard_plan(none, 4).count() == 0


def test_filter_lets_single_texts_through(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2500).alias("text"))
    words, bits = exact_dedup.repeat_filter(df)
    maybe = df.where(exact_dedup.possibly_repeated(F.col("text"), words.scalar(), bits))
    texts = Counter(r.text for r in df.collect())
    found = {r.text for r in maybe.collect()}
    assert {t for t, n in texts.items() if n > 1} <= found
    assert len(found) < 700


def test_shards_cover_all_rows_without_gaps(docs):
    df = docs([(i, f"text {i}", "en", "a", 1) for i in range(100, 400)])
    got = sharding.shard_plan(df, 7).collect()
    assert len(got) == df.count()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 7 and r.law == "key" and r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of_key = defaultdict(set)
    for r in got:
        of_key[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in of_key.values())
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].size == 16 and by_id[3].text_crc32 == 0 and by_id[4].size == 16
    assert by_id[100].text_crc32 == zlib.crc32(b"text 100")


def test_a_row_repeated_often_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 10)
    df = spark.range(95).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_plan(df, 3).collect()
    assert sorted(r.slot for r in got) == list(range(95))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    both = sharding.sharded(sharding.sharded(df, "k", 10), "k", 11, "grown").collect()
    moved = [r for r in both if r.shard != r.grown]
    assert all(r.grown == 10 for r in moved)
    assert 250 < len(moved) < 480
    sizes = Counter(r.shard for r in both)
    assert max(sizes.values()) < 1.25 * 400 and min(sizes.values()) > 0.75 * 400


def test_weights_set_the_shares(spark):
    df = spark.range(6000).withColumnRenamed("id", "k")
    sizes = Counter(r.shard for r in sharding.sharded(df, "k", [1, 2, 3]).collect())
    assert abs(sizes[0] - 1000) < 150 and abs(sizes[2] - 3000) < 200
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("k"), [1, 0])
