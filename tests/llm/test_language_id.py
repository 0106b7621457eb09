import random
import tracemalloc

import numpy as np
import pyarrow as pa
from manybody.llm import language_id as li
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = li.op7_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right > 0.97 and n > 100


def test_edges(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in (("the cat and the dog sat there", "en"), ("le chat et le chien sont la", "fr"), ("der hund und die katze sind da", "de"))]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, None), (2, ""), (3, "123 $$$"), (4, "the dog and the cat " * 40_000), (None, "le chien et le chat"), (4, "der hund")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in li.identify(docs, model).collect())
    assert [g[:2] for g in got] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "de"), ("4", "en"), ("None", "fr")]
    assert all(0 <= g[2] <= 1 for g in got)
    none = li.fit(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in li.identify(docs, none).collect()} == {"und"}
    assert li.identify(docs.where("false"), model).count() == 0


def test_pieces_sum_up(monkeypatch):
    texts = ["Abc déf " * 50, None, "x"]
    whole = li._grams([texts[0]])
    assert len(whole[0]) == 2
    monkeypatch.setattr(li, "PIECE", 100)
    assert sum(len(p) - (n & 3) for held in li._pieces(texts) for _, p, n in held) == 401


def test_stage_drops_foreign_texts(spark):
    """Of texts in no learned language all go, and no other document does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(4)
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))
    foreign = ["我们今天去北京看长城，天气很好。", "Привет", "Мы сегодня поехали в город и увидели много интересных вещей.", "今日は町に行って面白いものを見ました。", "Σήμερα πήγαμε στην πόλη", noise(20), noise(300), noise(20_000)]
    rows = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in li.stage_language(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    assert kept == {x.doc_id for x in docs.collect()}


def test_copies_are_learned_from_once(spark, monkeypatch):
    """A text with thousands of copies doesn't crowd out the others."""
    seen, svm = [], li.svm
    monkeypatch.setattr(li, "svm", lambda x, y: seen.append((len(x), np.unique(x, axis=0).shape[0])) or svm(x, y))
    rows = [(f"{w} text {i} of the {w}s", lang) for lang, w in (("en", "house"), ("fr", "maison"), ("de", "haus")) for i in range(40)]
    rows = [(t.translate(str.maketrans("0123456789", "abcdefghij")), lang) for t, lang in rows]
    copies = spark.createDataFrame([(t, "en") for t in [rows[7][0]] * 3000], "text string, lang string")
    li.fit(spark.createDataFrame(rows, "text string, lang string").unionByName(copies))
    assert seen[0] == (120, 120)


def test_stage_columns_of_the_model_and_long_texts(spark):
    """A column named as the model's stays as it is; n-grams across the pieces of a long text count as in one piece."""
    rows = [(i, t, lang, "mine", 5.0) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr")] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = li.stage_language(spark, docs, "").collect()
    assert out and {(r.lang_pred, r.score) for r in out} == {("mine", 5.0)}
    text = "ein Wort und noch eines " * 9
    count = lambda: np.sum([np.bincount(f[f >= 0], minlength=1 << li.BITS) for held in li._pieces([text]) for f in li._grams([p for _, p, _ in held], [n for *_, n in held])[1]], axis=0)
    whole, was = count(), li.PIECE
    try:
        li.PIECE = 7
        assert (count() == whole).all()
    finally:
        li.PIECE = was


def test_learning_holds_no_dense_matrix():
    """The driver's matrix of a full sample takes a small part of a dense one, and its products are the same."""
    rng = np.random.default_rng(2)
    width, texts = 1 << li.BITS, 600
    index = [np.sort(rng.choice(width, 700, replace=False)).astype(np.int32) for _ in range(texts)]
    value = [rng.random(700).astype(np.float32) for _ in range(texts)]
    index[5], value[5] = index[4], value[4]
    got = pa.table({"lang": ["ab"[k % 2 if k != 5 else 0] for k in range(texts)], "i": pa.array(index, pa.list_(pa.int32())), "v": pa.array(value, pa.list_(pa.float32()))})
    tracemalloc.start()
    x, lang, once = li._matrix(got)
    fitted = li.svm(x.scaled(np.ones(width, np.float32)), np.where(lang == "a", 1, -1).astype(np.float32), rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < texts * width * 4 * 1.5
    dense = np.asarray(x)
    assert len(x) == texts and len(once) == texts - 1 and lang.tolist() == sorted(lang.tolist())
    v, s = rng.random(width).astype(np.float32), rng.random(texts).astype(np.float32)
    np.testing.assert_allclose(x @ v, dense @ v, rtol=1e-4)
    np.testing.assert_allclose(x.T @ s, dense.T @ s, rtol=1e-4, atol=1e-6)
    np.testing.assert_allclose(x.mean(), dense.mean(axis=0, dtype=np.float64), rtol=1e-6)
    np.testing.assert_allclose(np.asarray(x.take(np.array([7, 3]))), dense[[3, 7]])
    want = li.svm(dense, np.where(lang == "a", 1, -1).astype(np.float32), rounds=3)
    np.testing.assert_allclose(fitted[0], want[0], rtol=1e-2, atol=1e-4)
    back = li._matrix(got.take(list(range(texts))[::-1]))
    assert (np.asarray(back[0]) == dense).all()
