import numpy as np
import pytest
from manybody.functions import morton as mk
from manybody.operators import direct
from manybody.plans import sets, tree
from manybody.plans.engine import HelmholtzEngine, LaplaceEngine, YukawaEngine
from manybody.sources import points as src
from pyspark.sql import functions as F


def points(spark, n=1500, seed=1, clustered=True):
    r = np.random.default_rng(seed)
    x = r.uniform(-1, 1, (n, 3))
    if clustered:
        x[: n // 2] = 0.3 + r.normal(size=(n // 2, 3)) * 0.01
    x[5] = x[6]
    q = r.uniform(-1, 1, (n, 5))
    rows = [(i, i, *map(float, x[i]), *map(float, q[i])) for i in range(n)]
    return spark.createDataFrame(rows, "point_id long, source_id long, x double, y double, z double, q double, q1 double, mx double, my double, mz double")


def test_potentials_and_gradients(spark):
    pts = points(spark).cache()
    for p, bound in ((5, 1e-3), (9, 1e-5)):
        e = LaplaceEngine(p=p, max_points_per_leaf=30, gradients=True).build(pts, pts)
        kinds = {r.kind: r.pairs for r in e.list_sizes().collect()}
        assert min(kinds[k] for k in "UVWX") > 0
        got, want = e.evaluate(pts).cache(), direct.laplace(pts, pts, gradients=True).cache()
        assert got.count() == 1500
        # twice the degree's nominal error, which is for 1e5 points; gradients lose about a digit
        assert direct.relative_l2(got, want, ["phi"]) < 2 * bound
        assert direct.relative_l2(got, want, ["gx", "gy", "gz"]) < 20 * bound


def test_dipoles_vectors_and_other_targets(spark):
    pts = points(spark, 900, 2)
    targets = points(spark, 200, 3, False).select("point_id", "x", "y", "z")
    e = LaplaceEngine(p=8, max_points_per_leaf=20, gradients=True, dipole=True).build(pts, targets)
    got = e.evaluate(pts.select("source_id", "mx", "my", "mz")).cache()
    want = direct.dipoles(targets, pts, gradients=True).cache()
    assert direct.relative_l2(got, want, ["phi"]) < 1e-4
    assert direct.relative_l2(got, want, ["gx", "gy", "gz"]) < 1e-3
    e = LaplaceEngine(p=6, vectors=2, max_points_per_leaf=20).build(pts, targets)
    two = e.evaluate(pts.select("source_id", F.col("q").alias("q0"), "q1"))
    want = direct.laplace(targets, pts.withColumn("q", F.col("q1"))).withColumnRenamed("phi", "phi1")
    assert direct.relative_l2(two, want, ["phi1"]) < 1e-3


def test_tree_rules(spark):
    pts = points(spark, 2000, 4)
    keys = tree.keyed(pts, tree.domain_of(pts))
    raw = tree.levels(keys, 10)
    boxes = tree.balanced(raw).cache()
    leaves = boxes.where("is_leaf")
    assert tree.complete(leaves) and tree.is_balanced(boxes) and not tree.is_balanced(raw)
    assert boxes.select("key").distinct().count() == boxes.count()
    again = tree.balanced(boxes)
    assert again.exceptAll(boxes).count() == 0
    assert tree.leaf_of(keys, boxes).where(~mk.is_ancestor("leaf", "key16")).count() == 0 and tree.leaf_of(keys, boxes).count() == 2000
    assert tree.linearised(boxes).exceptAll(leaves.select("key")).count() == 0
    # every pair of leaves is met exactly once: near, or through one list of them or their ancestors
    ls = tree.lists(boxes).cache()
    below = leaves.select(F.col("key").alias("leaf"), F.explode(mk.ancestors(F.col("key"))).alias("key"))
    t, s = below.select(F.col("leaf").alias("a"), F.col("key").alias("target")), below.select(F.col("leaf").alias("b"), F.col("key").alias("source"))
    met = ls.join(t, "target").join(s, "source").groupBy("a", "b").count()
    n = leaves.count()
    assert met.where("count <> 1 OR a = b").count() == 0 and met.count() == n * n - n


def test_yukawa_and_helmholtz(spark):
    pts = points(spark, 700, 5).selectExpr("*", "q AS q_re", "q1 AS q_im").cache()
    names = [f"{n}_{c}" for n in ("phi", "gx", "gy", "gz") for c in ("re", "im")]
    for k in (1.0, 1.5 + 0.5j):
        e = HelmholtzEngine(k, tolerance=1e-5, gradients=True, max_points_per_leaf=15).build(pts, pts)
        got, want = e.evaluate(pts).cache(), direct.helmholtz(pts, pts, complex(k).real, complex(k).imag, gradients=True).cache()
        assert direct.relative_l2(got, want, names[:2]) < 1e-4 and direct.relative_l2(got, want, names[2:]) < 2e-3
    e = YukawaEngine(2.0, tolerance=1e-4, gradients=True, max_points_per_leaf=15).build(pts, pts)
    got, want = e.evaluate(pts).cache(), direct.yukawa(pts, pts, 2.0, gradients=True).cache()
    assert direct.relative_l2(got, want, ["phi"]) < 1e-3 and direct.relative_l2(got, want, ["gx", "gy", "gz"]) < 2e-2


def test_errors_are_raised(spark):
    pts = points(spark, 60, 6)
    with pytest.raises(ValueError, match="outside"):
        LaplaceEngine(3, domain=(0.0, 0.0, 0.0, 0.5, 0.5, 0.5)).build(pts, pts)
    with pytest.raises(ValueError, match="two strengths"):
        LaplaceEngine(3).build(pts, pts).evaluate(pts.union(pts))
    with pytest.raises(Exception, match="missing"):
        direct.relative_l2(pts.where("point_id > 3"), pts, ["q"])


def test_key_sets(spark):
    pts = points(spark, 400, 7)
    d = tree.domain_of(pts)
    k = pts.select(mk.point_key("x", "y", "z", d, 5).alias("key")).distinct().cache()
    done = sets.completed(k)
    assert sets.is_complete(done) and k.exceptAll(done).count() == 0
    assert sets.is_linear(k) and not sets.is_linear(sets.with_ancestors(k)) and not sets.is_complete(k)
    assert sets.gaps(k).union(k).exceptAll(done).count() == 0
    assert [r.key for r in sets.completed(k.where("false")).collect()] == [0]
    boxes = tree.balanced(tree.levels(tree.keyed(pts, d), 20)).cache()
    assert sets.is_valid_tree(boxes.where("is_leaf").select("key"))
    # an overlap that makes up for a gap in volume
    eight = spark.range(1).select(F.explode(mk.children(F.lit(0))).alias("key"))
    first = eight.orderBy("key").limit(1)
    assert sets.is_complete(eight) and tree.complete(eight.exceptAll(first).union(eight.orderBy(F.desc("key")).limit(1))) and not sets.is_complete(eight.exceptAll(first).union(eight.orderBy(F.desc("key")).limit(1)))
    ls = tree.lists(boxes)
    own = boxes.where("is_leaf").orderBy("key").limit(9).select("key")
    need = {r.key for r in sets.essential(ls, own).collect()}
    assert {r.key for r in own.collect()} | {0} <= need <= {r.key for r in boxes.collect()}
    top = sets.stratified(pts.withColumn("g", F.col("point_id") % 7), "g", "point_id", 5)
    assert [r["count"] for r in top.groupBy("g").count().collect()] == [5] * 7
    b = k.withColumn("w", F.lit(1)).withColumn("v", F.when(F.col("key") < 2**62, 9).otherwise(1))
    one, two = sets.cut_at(b, "w", 4), sets.recut(b, "w", "v", 4)
    assert len(one) == 3 and two == sets.cut_at(b, "v", 4) and sets.recut(b, "w", "w", 4) == one
    assert sets.imbalance(b, "w", one) < 1.1 and sets.cut_at(b.where("false"), "w", 4) == []


def test_sources(spark):
    n = 4000
    for df, inside in ((src.cube(spark, n), "abs(x) <= 1 AND abs(y) <= 1 AND abs(z) <= 1"), (src.ball(spark, n), "x*x+y*y+z*z <= 1"), (src.sphere(spark, n), "abs(x*x+y*y+z*z-1) < 1e-9"), (src.plummer(spark, n), "x*x+y*y+z*z <= 1.0001"), (src.fibonacci_sphere(spark, n), "abs(x*x+y*y+z*z-0.25) < 1e-9"), (src.clusters(spark, n, [(0, 0, 0)], 0.1), "abs(x) < 0.4 AND abs(y) < 0.4 AND abs(z) < 0.4")):
        assert df.where(f"NOT ({inside})").count() == 0 and df.repartition(3).exceptAll(df).count() == 0
        m = df.agg(*[F.avg(a) for a in "xyz"]).first()
        assert max(map(abs, m)) < 0.05
    q = src.with_charges(src.cube(spark, n), dipoles=True)
    assert q.where("abs(q) > 1 OR abs(mx) > 1").count() == 0 and src.sample(q, 50).distinct().count() == 50
