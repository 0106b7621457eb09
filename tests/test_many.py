import numpy as np
import pytest
from manybody.operators.kernels import POINTS, Laplace, Yukawa
from manybody.plans.engine import LaplaceEngine
from pyspark.sql import functions as F


@pytest.mark.parametrize("kernel", (Laplace(6), Laplace(4, vectors=2, gradients=True, dipole=True), Yukawa(0.5, p=4)))
@pytest.mark.parametrize("kind", "ML")
def test_many_boxes_at_once(kernel, kind):
    """As box by box, for boxes of one point, of some, and of more than are taken at once."""
    rng = np.random.default_rng(5)
    n = np.array([1, 3, POINTS + 1, 2, 1])
    levels, begin, x = np.array([2, 5, 3, 3, 7]), np.cumsum(n) - n, rng.uniform(0.2, 0.9, (n.sum(), 3))
    s = rng.normal(size=(n.sum(), len(kernel.parameters)))
    got = kernel.expansions(kind, levels, x, s, begin)
    want = np.stack([kernel.expand(kind, v, x[b : b + k], s[b : b + k]) for v, b, k in zip(levels.tolist(), begin, n, strict=True)])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    got = kernel.evaluations(kind, levels, x, want, begin)
    want = np.concatenate([kernel.evaluate(kind, v, x[b : b + k], c) for v, b, k, c in zip(levels.tolist(), begin, n, want, strict=True)])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_tasks_take_many_boxes_at_once(spark, monkeypatch, tmp_path):
    """Harmonics are not made pair by pair: with leaves of one point and W and X pairs, calls are few."""

    def counted(name):
        plain = getattr(Laplace, name)

        def f(self, *args):
            with open(tmp_path / name, "a") as out:
                out.write("x")
            return plain(self, *args)

        return f

    pts = spark.range(400).select(F.col("id").alias("point_id"), F.col("id").alias("source_id"), *[F.pow(F.rand(k), 3).alias(a) for k, a in enumerate("xyz")], F.lit(1.0).alias("q"))
    pts = pts.cache()
    engine = LaplaceEngine(3, max_points_per_leaf=2).build(pts, pts)
    pairs = engine.lists.where("kind IN ('W', 'X')").count()
    assert pairs > 1000
    for name in ("expand", "evaluate"):
        monkeypatch.setattr(Laplace, name, counted(name))
    engine.evaluate(pts).collect()
    assert not list(tmp_path.iterdir())
