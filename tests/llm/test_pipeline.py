import corpus_pipeline as cp
from manybody.llm.ngram_join import jaccard_components
from manybody.llm.toxicity import TOXIC_FROM, fit, grade
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language", "toxicity", "near duplicates", "mixing", "tokens"]
    first = cp.STAGES[0][1](spark, docs, D).cache()
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.count()
    second = cp.STAGES[1][1](spark, first, D).cache()
    model = fit(first, spark.read.parquet(f"{D}/labels.parquet"))
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in grade(first, model).where(F.col("severity") < TOXIC_FROM).collect()}
    third = cp.STAGES[2][1](spark, second, D).cache()
    groups = {r.component_id for r in jaccard_components(second).collect()}
    assert sorted(r.doc_id for r in third.collect()) == sorted(groups) and third.columns == docs.columns


def test_repeats_in_the_near_duplicate_stage(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (3, None), (3, None), (None, "a b"), (4, "")]
    got = cp.STAGES[2][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), D)
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "3", "4", "None"]


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
