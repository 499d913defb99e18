"""The corpus pipeline as a whole against its stages by brute force, and on odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from dispensary.llm import quality
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    read = lambda t, *columns: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(*columns).collect()]
    want = brute.pipeline(read("documents", "doc_id", "lang", "text"), read("labels", "doc_id", "quality", "toxic"), read("benchmark", "item_id", "text"), quality)
    out = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", F.sha2("ids", 256), "decoded_sha256")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert 0 < len(want) < spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, shared ids and clashing names go through all stages; an empty table stays empty."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, passage, "en", "a", 7), (1, passage, "en", "a", 7), (1, "another text", "en", "b", 7), (None, None, None, None, None), (2, "", "en", "c", 7), (None, "a text without an id", "fr", "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("block", F.lit(1)).withColumn("rest", F.lit("r")).withColumn("found", F.lit(2))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
            if name != "encode":
                assert now.columns == docs.columns
            sources = sorted(str(r.source) for r in now.collect()) if name != "encode" else []
            assert name == "encode" or sources == ([] if table is not docs else ["None", "a", "b", "c", "d"] if name != "quality" else ["None", "a", "a", "b", "c", "d"])
        assert now.count() == (5 if table is docs else 0)
