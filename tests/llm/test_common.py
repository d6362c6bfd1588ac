from pyspark.sql import functions as F

from proofline.llm.common import give_back, lowest_by_hash, small_batches, stored


def test_sample_is_bounded_and_the_same_as_without_the_filter(spark):
    df = spark.range(20_000).withColumn("x", F.lit("y"))
    some = {r.id for r in lowest_by_hash(df, "id", 500).collect()}
    plain = {r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(500).collect()}
    assert some == plain
    assert lowest_by_hash(df.limit(7), "id", 500).count() == 7
    assert lowest_by_hash(df.where("false"), "id", 5).count() == 0


def test_stored_rows_and_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small_batches(spark, 3)
    try:
        df = spark.range(10).coalesce(1).mapInArrow(lambda it: it, "id long")
        assert stored(df).agg(F.sum("id")).first()[0] == 45
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    give_back()
