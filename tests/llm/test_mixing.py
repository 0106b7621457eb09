import numpy as np
from manybody.llm import mixing as m
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_rates_solve_the_least_squares_problem(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.5, 0.3, 0.1], 400)
    n = r.integers(0, 900, 400)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(400)], "doc_id long, n_tokens long, p array<double>")
    for targets in ({"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 1.0, "b": 0.0, "c": 0.0}):
        out, _, gap = m.rates(members, ["a", "b", "c"], targets)
        got = np.array([x.rate for x in out.orderBy("doc_id").select("rate").collect()])
        a, c = (p * n[:, None]).T, (p * n[:, None]).sum(axis=0)
        t = n.sum() * np.array([targets[k] for k in "abc"])
        x, y, was, step = np.ones(400), np.ones(400), np.ones(400), None
        w = a / np.sqrt(c)[:, None]
        scaled = w / np.sqrt(np.maximum(n, 1e-9))
        step = 1 / np.linalg.norm(scaled @ scaled.T, 2)
        for k in range(4000):  # the same problem, solved to the end
            x = np.maximum(0, y - step * p @ ((a @ y - t) / c))
            y, was = x + k / (k + 3) * (x - was), x
        loss = lambda v: float((((a @ v) - t) ** 2 / c).sum())
        assert targets["b"] == 0 or gap <= 2e-3
        assert (got >= 0).all() and loss(got) <= loss(x) + 2e-3 * loss(np.ones(400)) + 1e-3


def test_posteriors_hold_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    y = m.domain_of_labels(labels).where("domain <> 'toxic'")
    model = m.fit(docs, y.where("doc_id % 3 <> 0"))
    test = model.add(docs.select("doc_id", "text")).select("row.doc_id", "p").join(y.where("doc_id % 3 = 0"), "doc_id").selectExpr("domain", "p").collect()
    right = np.mean([model.domains[int(np.argmax(x.p))] == x.domain for x in test])
    assert right > 0.85 and all(abs(sum(x.p) - 1) < 1e-9 for x in test)


def test_stage_keeps_all_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = m.stage_mixing(spark, docs, SF)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.count() <= out.count() < 3 * docs.count()


def test_nulls_empty_and_repeats(spark, tmp_path):
    rows = [(1, None, 1), (1, "a b", 1), (None, "c", 1), (2, "", None), (3, "a b c " * 2000, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, p int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert m.op6_mixing(spark, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == 6003
    assert m.op6_mixing(spark, str(tmp_path)).count() == 5


def test_stage_reaches_its_target(spark, tmp_path):
    """Of as many plain as low words, plain documents repeat until they are 95 in 100 and low ones stay once."""
    rows = [(i, " ".join(f"{'abcdefgh'[(i * 7 + j) % 8]}{i % 2}" for j in range(40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    n = {r.low: r["count"] for r in m.stage_mixing(spark, docs, str(tmp_path)).groupBy((F.col("doc_id") % 2 == 0).alias("low")).count().collect()}
    assert n[True] == 100 and abs(n[False] / (n[True] + n[False]) - 0.95) < 0.01


def test_empty_labels_empty_documents_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, score string, ids int, p int, n_tokens int, again int, row int, rate int"
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4, 5, 6), (2, None, None, None, None, None, None, None, None)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in ([], [(9, 1, 0)]):  # none at all, none that belongs to a document
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert sorted((r.doc_id, r.rate, r.copies) for r in m.op6_mixing(spark, str(tmp_path)).collect()) == [(1, 1.0, 1), (2, 1.0, 1)]
        out = m.stage_mixing(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert {str(r) for r in m.stage_mixing(spark, docs, str(tmp_path)).collect()} == {str(r) for r in docs.collect()}
    assert m.stage_mixing(spark, docs.where("false"), str(tmp_path)).count() == 0
