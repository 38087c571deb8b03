"""The pipeline's stages on planted documents."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simgate.llm import queries
from simgate.llm.shared import written

from .test_operators import BASE, edited, prose


def test_stages(spark, tmp_path):
    item = prose(30, 900)
    texts = [BASE, BASE, BASE + " and an end", prose(50, 902), item + " " + prose(40, 903), "123 456 !!", None, "", prose(40, 904) + " mail me.you@there.org", prose(500, 905) + " " + " ".join(item.split()[:14])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int, extra string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), "test")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "token_ids" or docs.columns == columns
    assert set(kept["language"]) == {0, 1, 2, 3, 4, 8, 9}
    assert set(kept["near_duplicates"]) == {0, 3, 4, 8, 9}
    assert set(kept["decontamination"]) == {0, 3, 8, 9} == set(kept["token_ids"])
    assert "me.you@there.org" not in kept["personal_data"][8].text and kept["personal_data"][3].text == texts[3] and kept["personal_data"][8].extra == "own"
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 3, 8, 9}


def test_language_stage_drops_what_was_not_learned_and_keeps_all_letters_without_languages(spark, tmp_path):
    texts = [*(prose(50, s) for s in range(10)), "漢字かな漢字", "123 !!", None]
    docs = spark.createDataFrame([(i, t, "en" if i < 10 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    ids = lambda df: {r.doc_id for r in corpus_pipeline.identify(spark, df, str(tmp_path)).collect()}
    assert ids(docs) == set(range(10))
    assert ids(docs.withColumn("lang", F.lit(None).cast("string"))) == set(range(11))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
