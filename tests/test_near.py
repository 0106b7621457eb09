import numpy as np
import pytest
from manybody.operators import direct
from manybody.plans import near, sets
from manybody.plans.engine import LaplaceEngine
from pyspark.sql import functions as F


def crowded(spark, n=1200):
    r = np.random.default_rng(11)
    x = r.uniform(-1, 1, (n, 3)) ** 5
    q = r.uniform(-1, 1, n)
    rows = [(i, i, *map(float, x[i]), float(q[i])) for i in range(n)]
    return spark.createDataFrame(rows, "point_id long, source_id long, x double, y double, z double, q double")


def test_engine_with_a_near_rule(spark):
    """With all W and X pairs between leaves summed directly the lists change and the potentials stay."""
    pts = crowded(spark).cache()
    plain = LaplaceEngine(p=9, max_points_per_leaf=20).build(pts, pts)
    ruled = LaplaceEngine(p=9, max_points_per_leaf=20, near=lambda kind, s, t: F.lit(True)).build(pts, pts)
    one, two = ({r.kind: r.pairs for r in e.list_sizes().collect()} for e in (plain, ruled))
    assert min(one["W"], one["X"]) > 0 and one["V"] == two["V"] and two["U"] > one["U"]
    assert sum(one.values()) == sum(two.values())
    assert near.leaf_pairs(ruled.lists, ruled.counts()).count() == 0
    want = direct.laplace(pts, pts).cache()
    assert direct.relative_l2(plain.evaluate(pts), want, ["phi"]) < 2e-5
    assert direct.relative_l2(ruled.evaluate(pts), want, ["phi"]) < 2e-5
    work = ruled.work()
    p2p = work.where("kind = 'P2P'").agg(F.sum("n")).first()[0]
    assert p2p > plain.work().where("kind = 'P2P'").agg(F.sum("n")).first()[0]
    assert {r.kind for r in work.select("kind").distinct().collect()} <= set(near.KINDS)
    # the modelled costs as the second weight of a cut
    leaves = ruled.boxes.where("is_leaf").select("key")
    cost = near.CostModel(P2P=1.0, M2L=500.0).cost(work)
    blocks = leaves.join(cost, "key", "left").select("key", F.lit(1.0).alias("one"), F.coalesce("weight", F.lit(0.0)).alias("cost"))
    cuts = sets.recut(blocks, "one", "cost", 4)
    assert len(cuts) <= 3 and sets.imbalance(blocks, "cost", cuts) <= sets.imbalance(blocks, "cost", sets.cut_at(blocks, "one", 4))


def test_without_empty_boxes(spark):
    pts = crowded(spark, 600).cache()
    e = LaplaceEngine(p=3, max_points_per_leaf=10).build(pts.where("x < 0"), pts.where("x >= 0").select("point_id", "x", "y", "z"))
    counts = e.counts()
    kept = near.without_empty(e.lists, counts)
    gone = near.left_out(e.lists, counts).agg(F.sum("without_targets"), F.sum("without_sources")).first()
    assert min(gone) > 0 and kept.count() + sum(gone) == e.lists.count()
    assert counts.where("key = 0").select("sources", "targets").first() == (pts.where("x < 0").count(), pts.where("x >= 0").count())


@pytest.mark.parametrize("alphas", [{}, {"P2P": -1.0}, {"P2P": float("nan")}, {"M2L": 0.0}, {"XYZ": 1.0}])
def test_constants_that_a_model_refuses(alphas):
    with pytest.raises(ValueError):
        near.CostModel(**alphas)
