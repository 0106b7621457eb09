from manybody.operators import direct
from manybody.plans.engine import LaplaceEngine
from pyspark.sql import functions as F

from .test_engine import points


def test_coincident_points_are_summed_once(spark):
    """Twelve copies of each point: as many packed points as places, and each copy's result."""
    one = points(spark, 300, 8).select("x", "y", "z", "q", "q1", "point_id").cache()
    many = one.crossJoin(spark.range(12)).select((F.col("point_id") * 100 + F.col("id")).alias("point_id"), (F.col("point_id") * 100 + F.col("id")).alias("source_id"), "x", "y", "z", (F.col("q") + F.col("q1") * F.col("id")).alias("q")).cache()
    e = LaplaceEngine(p=9, max_points_per_leaf=20, gradients=True).build(many, many)
    places = one.select("x", "y", "z").distinct().count()
    assert e._sources_with(many).select(F.explode("ids")).count() == places and e.places.count() == places
    got = e.evaluate(many).cache()
    assert got.count() == 3600 and got.select("point_id").distinct().count() == 3600
    want = direct.laplace(many, many, gradients=True).cache()
    assert direct.relative_l2(got, want, ["phi"]) < 1e-4 and direct.relative_l2(got, want, ["gx", "gy", "gz"]) < 1e-3
