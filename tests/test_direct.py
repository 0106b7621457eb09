import inspect

import numpy as np
from manybody import queries as own
from manybody.operators import direct, metrics
from pyspark.sql import functions as F


def _points(spark, n, seed):
    r = np.random.default_rng(seed)
    rows = [(i, *map(float, v)) for i, v in enumerate(r.uniform(-1, 1, (n, 5)))]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, q_re double, q_im double")


def test_phases_by_table():
    z = np.concatenate([np.random.default_rng(1).uniform(0, 300, 20_000), np.arange(9) * np.pi / 4, [0.0]])
    c, s = direct._cos_sin(z)
    assert np.abs(c - np.cos(z)).max() < 1e-13 and np.abs(s - np.sin(z)).max() < 1e-13


def test_blocks_equal_a_plain_sum(spark, monkeypatch):
    """Packs and tiles that points don't fill, sources shared out among tasks, coincident points, nulls: as by one plain sum."""
    p = _points(spark, 700, 2)
    rows = np.array([r[1:] for r in sorted(p.collect())])
    d = rows[:300, None, :3] - rows[None, :, :3]
    r = np.sqrt((d * d).sum(axis=2))
    same = r == 0
    r[same] = 1
    k = 2.0 + 0.25j
    g = np.where(same, 0, np.exp(1j * k * r) / r) / (4 * np.pi)
    q = rows[:, 3] + 1j * rows[:, 4]
    phi, gx = g @ q, (g * (1j * k * r - 1) / (r * r) * d[..., 0]) @ q
    with_nulls = p.unionByName(spark.createDataFrame([(900, 0.1, 0.2, 0.3, None, 1.0), (901, None, 0.2, 0.3, 1.0, 1.0)], p.schema))
    targets = p.where("point_id < 300").unionByName(p.where("point_id = 0").select(F.lit(999).cast("long").alias("point_id"), F.lit(None).cast("double").alias("x"), "y", "z", "q_re", "q_im"))
    for rows_ in (direct.BROADCAST_ROWS, 100):
        monkeypatch.setattr(direct, "BROADCAST_ROWS", rows_)
        got = sorted(direct.helmholtz(targets, with_nulls, 2.0, 0.25, gradients=True).collect())
        assert [x.point_id for x in got] == [*range(300), 999] and got[-1].phi_re == 0
        assert np.allclose([complex(x.phi_re, x.phi_im) for x in got[:-1]], phi, rtol=1e-12, atol=1e-12)
        assert np.allclose([complex(x.gx_re, x.gx_im) for x in got[:-1]], gx, rtol=1e-10, atol=1e-10)


def test_no_row_for_a_pair(spark):
    """The plans have no row for a pair of points (they took most of the time), and scaled_errors passes over the pairs once."""
    e = own._emb(spark, "/root/testdata/sf0.001")
    for df in (direct.yukawa(e, e, 1.5), direct.helmholtz(e.withColumn("q_re", F.col("q")), e.withColumn("q_re", F.col("q")), 2.0, 0.25), metrics.magnitudes(e, e)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "s_x" not in plan
    assert inspect.getsource(own.scaled_errors).count("direct.") == 0
    both = metrics.magnitudes(e, e, potentials=True).join(direct.laplace(e, e).withColumnRenamed("phi", "want"), "point_id")
    assert both.where("abs(phi - want) > 1e-9 OR m1 < abs(phi) OR m2 <= 0").count() == 0 and both.count() == 500
