import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from proofline.llm import language
from proofline.llm.common import PIECE_MODEL, remainder_of_id, table
from proofline.llm.queries import QUERIES, SQL
from tests.llm.test_near_and_pieces import classes
from tests.llm.test_search_and_urls import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_matches_brute_force(spark):
    from sentencepiece import SentencePieceProcessor

    docs = table(spark, SF, "documents")
    filters = language.learn_filters(docs.where(remainder_of_id("doc_id", 3) != 1))
    rows = [(r.doc_id, r.text) for r in docs.collect() if filters.predict(r.text)[0] != "und"]
    last = {}
    for i, t in sorted(rows):
        last[t] = i
    rows = sorted((i, t) for t, i in last.items())
    rows = [(i, t) for (i, t), (_, c, _) in zip(rows, classes(rows)) if i == c]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not brute(t, items)[-1]]
    sp = SentencePieceProcessor(model_file=PIECE_MODEL)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.pieces for r in got} == {i: sp.encode(t) for i, t in rows}
    assert all(r.n_pieces == len(r.pieces) and r.same_text for r in got)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 30


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(SQL[name]).df()[list(mine.columns)]

    def rows(df):
        return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))

    assert rows(mine) == rows(theirs)


def test_entry_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('proofline.llm'): raise ModuleNotFoundError(name=name.split('.queries')[0])\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert e.queries() and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(corpus_pipeline.__file__), timeout=120)


def test_run_over_odd_rows(spark, docs, tmp_path):
    given = docs([(6, "The cat sat on the mat and looked at the dog in the garden all day long", "en", "a", 1)])
    extra = given.withColumn("words", given["doc_id"]).withColumn("score", given["text"])
    bench = spark.createDataFrame([(1, None), (1, "")], "item_id long, text string")
    for name, df in (("odd", extra), ("none", extra.where("false"))):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert all(r.same_text and r.n_pieces == len(r.pieces) for r in rows)
        # One of the equal texts stays; null and empty ones have no language.
        assert sorted(str(r.doc_id) for r in rows) == (["2", "5", "6", "None"] if name == "odd" else [])
