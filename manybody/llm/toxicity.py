"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the presence of a word or of a word's first bytes (inflected forms
share them), hashed to 2^20. Those that the labels tie to toxic texts are kept;
one weight vector w serves all thresholds t1 < t2 < t3:
P(grade >= k) = 1 / (1 + exp(t_k - w.x)), and the expected severity is their sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import BROADCAST_ROWS, fresh, small_batches, table

BITS = 20
PREFIXES = (3, 4, 5, 6, 7)
GRADES = 3


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, the text of each, and the words of each text."""
    buf, at = tb.utf8(batch.column("text"))
    words, where, pre = tb.word_hashes(tb.LOWER[buf], at, tb.NOT_ALNUM, PREFIXES)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(where))
    f, d = [words >> np.uint64(64 - BITS)], [doc]
    for k, h in zip(PREFIXES, pre, strict=True):
        on = np.flatnonzero(h)
        f.append(tb.mix(h[on] + np.uint64(k)) >> np.uint64(64 - BITS))
        d.append(doc[on])
    return np.concatenate(f).astype(np.int64), np.concatenate(d), np.diff(where)


def _document_frequency(batches):
    """Texts with each feature, by label."""
    with_, without = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for b in batches:
        y = np.asarray(b.column("bad").to_pylist(), bool)
        f, d, _ = _features(b)
        pair = np.unique(d << BITS | f)
        f, d = pair & ((1 << BITS) - 1), pair >> BITS
        with_ += np.bincount(f[y[d]], minlength=1 << BITS).astype(np.int32)
        without += np.bincount(f[~y[d]], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(with_)
    yield pa.record_batch([pa.array(at), pa.array(with_[at]), pa.array(without[at])], names=["f", "p", "q"])


def _chosen(select: np.ndarray):
    def run(batches):
        for b in batches:
            f, d, n = _features(b)
            on = np.flatnonzero(select[f])
            hits = np.bincount(d[on], minlength=b.num_rows)
            pair = np.unique(d[on] << BITS | f[on])
            lists = np.split(pair & ((1 << BITS) - 1), np.searchsorted(pair >> BITS, np.arange(1, b.num_rows))) if b.num_rows else []
            yield pa.record_batch([b.column("grade"), pa.array(hits), pa.array(n), pa.array(lists, pa.list_(pa.int64()))], names=["grade", "hits", "n", "f"])

    return run


class OrdinalModel:
    """weights: of the features, 0 for most; thresholds: rising."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, batch: pa.RecordBatch) -> np.ndarray:
        """P(grade >= k) by text and k."""
        f, d, _ = _features(batch)
        on = np.flatnonzero(self.weights[f])
        pair = np.unique(d[on] << BITS | f[on])
        x = np.bincount(pair >> BITS, self.weights[pair & ((1 << BITS) - 1)], minlength=batch.num_rows)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))


def train(y: np.ndarray, doc: np.ndarray, col: np.ndarray, cols: int, grades: int, ridge: float = 1e-5, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a small ridge. doc, col: the places of the ones of the feature matrix."""
    n = len(y)
    w, t, gaps = np.zeros(cols), 2.0, np.zeros(grades - 1)
    par = np.concatenate([w, [t], gaps])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for k in range(1, rounds + 1):
        w, cuts = par[:cols], par[cols] + np.concatenate([[0], np.cumsum(np.exp(np.clip(par[cols + 1 :], -8, 5)))])
        x = np.bincount(doc, w[col], minlength=n)
        s = 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -50, 50)))  # P(grade >= 1..K)
        full = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        p = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-9)
        ds = full * (1 - full)
        up, low = ds[np.arange(n), y], ds[np.arange(n), y + 1]
        gx = -(up - low) / p / n
        gc = np.zeros(grades)
        np.add.at(gc, np.maximum(y - 1, 0)[y > 0], (up / p / n)[y > 0])
        np.add.at(gc, np.minimum(y, grades - 1)[y < grades], -(low / p / n)[y < grades])
        gw = np.bincount(col, gx[doc], minlength=cols) + ridge * w
        gg = np.exp(np.clip(par[cols + 1 :], -8, 5)) * np.cumsum(gc[::-1])[::-1][1:]
        g = np.concatenate([gw, [gc.sum()], gg])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - 0.1 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return par[:cols], par[cols] + np.concatenate([[0], np.cumsum(np.exp(np.clip(par[cols + 1 :], -8, 5)))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = 20_000, max_features: int = 4096) -> OrdinalModel:
    """Learns from docs(doc_id, text) and labels(doc_id, <label>).

    The label is a grade 0..K; where it is only 0 or 1, the positive texts are graded
    1 to GRADES by thirds of the number of different toxic features in them. About max_docs labelled
    texts are looked at (chosen by a hash of doc_id), whole; of a doc_id's labels the
    greatest counts, and all rows that repeat it. At most max_features features are kept, those
    with the greatest likelihood ratio, which bounds the model whatever the vocabulary.
    """
    small_batches(docs.sparkSession)
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("grade"))
    n = y.count()
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, max_docs / max(1, n)) * (1 << 30))
    assert max_docs * 2 <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(y), "doc_id").select("text", "grade", (F.col("grade") > 0).alias("bad"))
    total = rows.groupBy("bad").count().collect()
    pos, neg = sum(r[1] for r in total if r[0]), sum(r[1] for r in total if not r[0])
    none = OrdinalModel(np.zeros(1 << BITS), np.arange(4.0, 4.0 + GRADES))
    if not pos or not neg:
        return none
    freq = rows.select("text", "bad").mapInArrow(_document_frequency, "f long, p int, q int").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = F.col("p"), F.col("q")
    odds = F.log((p + 0.5) / (pos + 1 - p)) - F.log((q + 0.5) / (neg + 1 - q))
    expected = (p + q) * pos / (pos + neg)
    # likelihood ratio: at 24 one in a million features is chosen by chance
    ratio = 2 * (p * F.log(p / expected) + F.when(q > 0, q * F.log(q / (p + q - expected))).otherwise(0.0))
    best = freq.where("p >= 3").select("f", odds.alias("odds"), ratio.alias("ratio")).where("ratio >= 24 AND odds >= 2").orderBy(F.desc("ratio"), "f").limit(max_features).collect()
    if not best:
        return none
    chosen = np.array([r["f"] for r in best])
    select = np.zeros(1 << BITS, bool)
    select[chosen] = True
    got = rows.select("text", "grade").mapInArrow(_chosen(select), "grade int, hits long, n long, f array<long>").toArrow()
    grade, hits, words = (got.column(c).to_numpy() for c in ("grade", "hits", "n"))
    grades = max(int(grade.max()), 1)
    if grades == 1:
        grades, bad = GRADES, grade > 0
        kinds = np.diff(np.asarray(got.column("f").combine_chunks().offsets))
        cuts = np.quantile(kinds[bad], np.arange(1, grades) / grades)
        grade = np.where(bad, 1 + np.searchsorted(cuts, kinds, "left"), 0)
    lists = got.column("f").combine_chunks()
    doc = np.repeat(np.arange(len(grade)), np.diff(np.asarray(lists.offsets)))
    col = np.searchsorted(np.sort(chosen), np.asarray(lists.flatten()))
    order = np.lexsort((hits, words, grade))  # the fit doesn't depend on the order of arrival
    w, cuts = train(grade[order].astype(np.int64), np.argsort(order)[doc], col, len(chosen), grades)
    weights = np.zeros(1 << BITS)
    weights[np.sort(chosen)] = w
    return OrdinalModel(weights, cuts)


def grade(docs: DataFrame, model: OrdinalModel, severity: str = "severity", likeliest: str = "grade") -> DataFrame:
    """docs with the expected grade and the likeliest added (or replaced); null and empty texts are graded as texts without toxic words."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (severity, likeliest)]
    docs = docs.select(*[f"`{c}`" for c in names])
    schema = StructType([*docs.schema.fields, StructField(severity, DoubleType()), StructField(likeliest, IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches):
        own = OrdinalModel(*sent.value)
        for b in batches:
            s = own.at_least(b)
            full = np.hstack([np.ones((len(s), 1)), s, np.zeros((len(s), 1))])
            yield pa.record_batch([*b.columns, pa.array(s.sum(axis=1)), pa.array(np.argmax(full[:, :-1] - full[:, 1:], axis=1).astype(np.int32))], names=[*names, severity, likeliest])

    return docs.mapInArrow(run, schema)


#: Expected severity from which a text counts as toxic.
TOXIC_FROM = 0.5


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of every document: doc_id, severity, grade, toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = grade(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.round("severity", 6).alias("severity"), "grade", (F.col("severity") >= TOXIC_FROM).alias("toxic"))


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of expected severity TOXIC_FROM or more go; the columns stay."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    severity, likeliest = fresh(docs.columns, "severity"), fresh(docs.columns, "grade")
    return grade(docs, model, severity, likeliest).where(F.col(severity) < TOXIC_FROM).select(*[f"`{c}`" for c in docs.columns])
