import random

import numpy as np
from manybody.llm import toxicity as tx
from pyspark.sql import functions as F


def corpus(n=900, seed=1):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        t = [r.choice(words) for _ in range(r.randrange(5, 200))]
        for _ in range(r.randrange(1, 9) if bad else 0):
            t[r.randrange(len(t))] = r.choice(["scoundrel", "scoundrels", "RASCAL", "villain"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, y.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    out = tx.grade(docs, model).join(y, "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([(r.severity >= tx.TOXIC_FROM) == bool(r.toxic) for r in out]) > 0.98
    assert all(0 <= r.severity <= tx.GRADES and 0 <= r.grade <= tx.GRADES for r in out)
    assert np.mean([r.severity for r in out if r.toxic]) > 1


def test_gradient_of_the_likelihood():
    r = np.random.default_rng(2)
    y, doc, col = r.integers(0, 4, 50), np.repeat(np.arange(50), 3), r.integers(0, 6, 150)
    w, t = tx.train(y, doc, col, 6, 3, rounds=1500)

    def loss(w, t):
        x = np.bincount(doc, w[col], minlength=50)
        s = np.hstack([np.ones((50, 1)), 1 / (1 + np.exp(t - x[:, None])), np.zeros((50, 1))])
        return -np.log(s[np.arange(50), y] - s[np.arange(50), y + 1]).mean() + 0.5e-5 * (w @ w)

    best = loss(w, t)
    for k in range(9):
        for e in (0.05, -0.05):
            w2, t2 = w.copy(), t.copy()
            (w2 if k < 6 else t2)[k % 6] += e
            assert loss(w2, t2) >= best - 1e-4


def test_edges(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "scoundrel villain rascal", "x"), (2, "fine " * 200_000, None)], "doc_id long, text string, grade string")
    got = {(r.doc_id, r.text and r.text[:4]): r.severity for r in tx.grade(odd, model).collect()}
    assert got.pop((None, "scou")) > 1 and all(v < 0.5 for v in got.values()) and len(got) == 3
    assert tx.grade(odd.where("false"), model).count() == 0
    none = tx.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert tx.grade(docs, none).where(F.col("severity") >= tx.TOXIC_FROM).count() == 0


def test_stage_keeps_columns_named_as_the_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "'mine' AS severity", "7 AS grade")
    out = tx.stage_toxicity(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and {(r.severity, r.grade) for r in out.collect()} == {("mine", 7)}
