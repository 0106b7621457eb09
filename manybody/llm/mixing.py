"""Mixing documents to target domain weights by soft membership, in DataFrame expressions only.

A naive Bayes classifier over hashed words, counted on a bounded sample of labelled
documents, gives each document's domain posteriors p_ik. Rates r_i >= 0 then solve
the least-squares problem

    minimise  sum_k (sum_i r_i n_i p_ik - t_k)^2 / c_k

(n_i: words, t_k: target words, c_k: words now) by accelerated projected
gradient steps from r = 1 in the metric of the words:
r_i <- max(0, y_i - step sum_k p_ik g_k / c_k), y being r with momentum.
A step needs only the K sums of the residual g at y, so a turn is one aggregate over the
table of posteriors; the steps taken are a short list of K numbers each.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, table

BUCKETS = 2048
#: A posterior weighs a document's mean evidence like so many words at most.
EVIDENCE = 40
TURNS, TOLERANCE, STEPS_KEPT = 60, 1e-5, 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class DomainModel:
    """domains in order; log priors; log likelihoods per domain and bucket."""

    def __init__(self, domains: list[str], prior: list[float], like: list[list[float]]):
        self.domains, self.prior, self.like = domains, prior, like

    def posteriors(self, text: Column) -> tuple[Column, Column]:
        """The words' buckets, and from the column ids of them the domains' log scores."""
        ids = F.transform(words(text), bucket)
        tables = [F.from_json(F.lit(json.dumps([round(x, 4) for x in row])), "array<double>") for row in self.like]
        add = lambda t: lambda a, i: a + F.get(t, i)
        sums = [F.aggregate("ids", F.lit(0.0), add(t)) for t in tables]
        n = F.greatest(F.size("ids"), F.lit(1))
        weight = F.least(n, F.lit(EVIDENCE)) / n
        score = F.array(*[F.lit(p) + s * weight for p, s in zip(self.prior, sums, strict=True)]) if sums else F.array().cast("array<double>")
        return ids, score

    def add(self, docs: DataFrame, name: str = "p") -> DataFrame:
        """docs as the struct column row, with the array column <name> of probabilities and n_tokens.

        A text without words has the priors; without domains the array is empty. Columns
        of docs may have any names; text is read.
        """
        ids, score = self.posteriors(F.col("row.text"))
        out = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")).withColumn("ids", ids).withColumn("score", score)
        top = F.array_max("score")
        out = out.withColumn("score", F.transform("score", lambda x: F.exp(x - top)))
        total = F.aggregate("score", F.lit(0.0), lambda a, x: a + x)
        return out.select("row", F.transform("score", lambda x: x / total).alias(name), F.size("ids").cast("long").alias("n_tokens"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 10_000) -> DomainModel:
    """Counts words of docs(doc_id, text) by the domain in labels(doc_id, domain).

    About max_docs labelled documents are counted, whole, chosen by a hash of doc_id;
    labels that are null, and documents of several domains (the least counts), do no harm.
    """
    y = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = y.count()
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, max_docs / max(1, n)) * (1 << 30))
    assert 2 * max_docs <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("domain", F.explode_outer(F.transform(words(F.col("text")), bucket)).alias("b"))
    seen = rows.groupBy("domain", "b").agg(F.count("*").alias("c")).collect()  # at most domains x BUCKETS rows
    sizes = {r[0]: r[1] for r in y.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("domain").count().collect()}
    domains = sorted(sizes)
    total = sum(sizes.values())
    like = []
    for d in domains:
        c = [1.0] * BUCKETS
        for r in seen:
            if r["domain"] == d and r["b"] is not None:
                c[r["b"]] += r["c"]
        s = sum(c)
        like.append([math.log(x / s) for x in c])
    return DomainModel(domains, [math.log(sizes[d] / total) for d in domains], like)


def _start() -> Column:
    return F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("was"))


def _fold(start: Column, steps: list[list[float]], k: int, least: float = 0.0) -> Column:
    """A struct (r, was) after further steps: each a momentum b and K numbers h, r <- max(least, r + b (r - was) - p.h)."""
    if not steps:
        return start
    flat = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")

    def one(s, h):
        move = F.get(h, F.lit(1)) * F.get(F.col("p"), F.lit(0))
        for i in range(1, k):
            move = move + F.get(h, F.lit(i + 1)) * F.get(F.col("p"), F.lit(i))
        r = F.greatest(F.lit(float(least)), s["r"] + F.get(h, F.lit(0)) * (s["r"] - s["was"]) - move)
        return F.struct(r.alias("r"), s["r"].alias("was"))

    return F.aggregate(flat, start, one)


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, least: float = 0.0) -> tuple[DataFrame, list[list[float]], float]:
    """Rates of members(p, n_tokens, ...): members with the column rate, all steps taken, and the gap.

    targets: a share for each domain (any positive scale). budget: words wanted in
    all, by default as many as there are; a negative number: the fewest with which no
    domain shrinks. least: no rate is lower. The gap is the largest distance of a
    domain's words from its target, as a part of the budget: at most TOLERANCE unless
    the rates' bound or TURNS turns stand in the way. Without domains, without targets
    for them or without words all rates are 1.
    """
    k = len(domains)
    if not k or sum(targets.get(d, 0.0) for d in domains) <= 0:
        return members.withColumn("rate", F.lit(1.0)), [], 0.0
    sums = lambda df, rate: [x or 0.0 for x in df.agg(*[F.sum(rate * F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(k)]).first()]
    now = sums(members, F.lit(1.0))
    share = [targets.get(d, 0.0) / sum(targets.get(x, 0.0) for x in domains) for d in domains]
    total = sum(now) if budget is None else budget if budget >= 0 else max([c / s for c, s in zip(now, share, strict=True) if s > 0] or [0.0])
    want = [total * s for s in share]
    scale = [max(c, 1e-9 * max(sum(now), 1.0)) for c in now]
    # the scaled Gram matrix's largest eigenvalue is at most its largest row sum
    gram = members.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))) for i in range(k) for j in range(k)]).first()
    top = max([sum((gram[i * k + j] or 0.0) / (scale[i] * scale[j]) ** 0.5 for j in range(k)) for i in range(k)] or [1.0]) or 1.0
    start, table_, kept, steps, short = _start(), members, [], [], 0.0
    for turn in range(TURNS + 1):
        b = turn / (turn + 3)
        ahead = table_.withColumn("s", _fold(start, kept, k, least))
        have = sums(ahead, F.col("s.r") + b * (F.col("s.r") - F.col("s.was"))) if steps else now
        gap = [a - t for a, t in zip(have, want, strict=True)]
        short = max(abs(g) for g in gap) / max(total, 1.0)
        if short <= TOLERANCE or turn == TURNS:
            break
        step = [b, *(g / s / top for g, s in zip(gap, scale, strict=True))]
        kept.append(step)
        steps.append(step)
        if len(kept) == STEPS_KEPT:
            table_ = materialise(table_.withColumn("state", _fold(start, kept, k, least)), "rates")
            start, kept = F.col("state"), []
    return table_.withColumn("rate", _fold(start, kept, k, least)["r"]), steps, short


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate, rounded up with the probability of its fraction, by a hash of the key."""
    u = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000)) / 1e6
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as domains: toxic, low, plain; null where either is null."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 0), "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "plain").alias("domain"))


#: Shares of the words wanted of each domain.
TARGETS = {"plain": 0.90, "low": 0.08, "toxic": 0.02}


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's rate: doc_id, n_tokens, p_<domain> for the three domains, rate, copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, domain_of_labels(table(spark, sf_dir, "labels")))
    members = materialise(model.add(docs).select("row.doc_id", "n_tokens", "p"), "members")
    out, _, _ = rates(members, model.domains, TARGETS)
    place = {d: i for i, d in enumerate(model.domains)}
    p = [(F.round(F.get("p", F.lit(place[d])), 6) if d in place else F.lit(0.0)).alias(f"p_{d}") for d in sorted(TARGETS)]
    return out.select("doc_id", "n_tokens", *p, F.round("rate", 6).alias("rate"), copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: plain and low documents at 95 to 5 of the words; documents repeat as their rates ask.

    The budget is the least with which no domain shrinks, and no rate is solved for
    below 1: mixing repeats what is scarce and drops nothing. Columns of any names
    stay as they are; without usable labels every document stays once.
    """
    labels = domain_of_labels(table(spark, sf_dir, "labels")).where("domain <> 'toxic'")
    model = fit(docs.select("doc_id", "text"), labels)
    wide = materialise(model.add(docs), "members")
    out, steps, _ = rates(wide.select("n_tokens", "p"), model.domains, {"plain": 0.95, "low": 0.05}, budget=-1, least=1.0)
    rate = _fold(_start(), steps, len(model.domains), 1.0)["r"] if steps else F.lit(1.0)
    return wide.select("row", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), copies(rate, F.col("row.doc_id")))))).select("row.*")
