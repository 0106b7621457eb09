import os
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from manybody.functions import morton as mk
from manybody.plans import tree
from manybody.sources import files
from manybody.sources import points as src
from pyspark.sql import functions as F


def results(spark, n, vectors, seed):
    r = np.random.default_rng(seed).normal(size=(n, 4 * vectors))
    names = [f"{c}{v}" if vectors > 1 else c for v in range(vectors) for c in ("phi", "gx", "gy", "gz")]
    rows = [(i, *map(float, r[i])) for i in np.random.default_rng(1).permutation(n).tolist()]
    return r, spark.createDataFrame(rows, ", ".join(["point_id long", *[f"{c} double" for c in names]]))


@pytest.mark.parametrize("full", [True, False])
def test_outputs_round_trip_and_compare(spark, tmp_path, full):
    a, one = results(spark, 70, 2, 3)
    b, two = results(spark, 70, 2, 4)
    for name, df in (("a", one), ("b", two)):
        assert files.write_output(f"{tmp_path}/{name}", df, 2, full) == 70
    assert os.path.getsize(f"{tmp_path}/a") == 24 + 70 * 64
    back = {x.row: x.v for x in files.read_outputs(spark, f"{tmp_path}/a").collect()}
    assert np.array_equal(np.array([back[i] for i in range(70)]), a)
    got = files.compared_outputs(*(files.read_outputs(spark, f"{tmp_path}/{n}") for n in "ab"), vectors=2).first()
    d, a, b = (b - a).reshape(70, 2, 4), a.reshape(70, 2, 4), b.reshape(70, 2, 4)
    l2 = [np.sqrt((d[:, m, s] ** 2).sum() / (a[:, m, s] ** 2).sum()) for s in (slice(0, 1), slice(1, 4)) for m in range(2)]
    most = [np.sqrt((d[:, m, s] ** 2).sum(axis=1)).max() for s in (slice(0, 1), slice(1, 4)) for m in range(2)]
    rms = lambda v: np.sqrt(np.mean(np.square(v)))
    assert got.n == 70 and np.allclose(got[1:], [rms(l2[:2]), rms(most[:2]), rms(l2[2:]), rms(most[2:])])
    with open(f"{tmp_path}/short", "wb") as f:
        f.write(open(f"{tmp_path}/a", "rb").read()[:-8])
    with pytest.raises(Exception, match="length is wrong"):
        files.read_outputs(spark, f"{tmp_path}/short").count()
    with pytest.raises(ValueError):
        files.write_output(f"{tmp_path}/c", one.withColumn("gx1", F.lit(None).cast("double")), 2)


def test_wave_files_round_trip(spark, tmp_path):
    r = np.random.default_rng(5)
    x, q = r.normal(size=(30, 3)), r.normal(size=30) + 1j * r.normal(size=30)
    files.write_wave_problem(f"{tmp_path}/p", x, q, np.array([4, 2, 29]), 9)
    rows = files.read_wave_problems(spark, f"{tmp_path}/p").orderBy("point_id").collect()
    assert np.array_equal([(t.x, t.y, t.z) for t in rows], x) and np.array_equal([t.q_re + 1j * t.q_im for t in rows], q)
    assert [t.point_id for t in rows if t.sampled] == [2, 4, 29]
    phi, grad = q, x + 1j * x[::-1]
    for full in (True, False):
        files.write_wave_output(f"{tmp_path}/o{full}", phi, grad, full)
        got = np.array([t.v for t in files.read_wave_outputs(spark, f"{tmp_path}/o{full}").orderBy("row").collect()])
        assert np.array_equal(got[:, 0] + 1j * got[:, 1], phi) and np.array_equal(got[:, 2::2] + 1j * got[:, 3::2], grad)
    with pytest.raises(Exception, match="no wave problem"):
        files.read_wave_problems(spark, f"{tmp_path}/oTrue").count()


def test_partitioned_tree(spark, tmp_path):
    keys = tree.keyed(src.of_keys(spark.range(1, 400).withColumnRenamed("id", "k"), "k"), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0))
    leaves = tree.levels(keys, 20, max_level=4).where("is_leaf").select("key").cache()
    n = files.pvtu(leaves, (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), str(tmp_path), "tree", 3)
    assert n == leaves.count()
    pieces = [p.get("Source") for p in ET.parse(f"{tmp_path}/tree.pvtu").iter("Piece")]
    assert pieces == [f"tree.rank{i}.vtu" for i in range(3)]
    found, volume = [], 0.0
    for rank, p in enumerate(pieces):
        root = ET.parse(f"{tmp_path}/{p}")
        arrays = {a.get("Name"): a.text.split() for a in root.iter("DataArray")}
        assert set(arrays["owner_rank"]) <= {str(rank)}
        found.append([int(k) for k in arrays["morton_key"]])
        x = np.array(arrays[None], float).reshape(-1, 8, 3)
        volume += (x[:, 6] - x[:, 0]).prod(axis=1).sum()
    assert sorted(sum(found, [])) == sorted(r.key for r in leaves.collect()) and abs(volume - 1) < 1e-12
    assert all(a[-1] < b[0] for a, b in zip(found, found[1:], strict=False))
    assert files.pvtu(leaves.where("false"), (0.0, 0.0, 0.0, 1.0, 1.0, 2.0), str(tmp_path), "none", 2) == 0
    assert not [f for f in os.listdir(tmp_path) if "tmp" in f or f.count(".") > 2]
    # a failure leaves no manifest
    with pytest.raises(Exception, match="invalid key"):
        files.pvtu(spark.createDataFrame([(-1,)], "key long"), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), str(tmp_path), "tree", 1)
    assert not os.path.exists(f"{tmp_path}/tree.pvtu")
    for stem, side in (("a/b", 1.0), ("", 1.0), ("ok", 0.0)):
        with pytest.raises(ValueError):
            files.pvtu(leaves, (0.0, 0.0, 0.0, side, 1.0, 1.0), str(tmp_path), stem, 1)


def test_splitmix_and_random_keys(spark):
    got = [r[0] % 2**64 for r in spark.range(3).select(src.splitmix64(0, "id")).collect()]
    assert got == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    r = spark.range(20_000).select(src.splitmix_uniform(7, "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= r[0] < 0.001 and 0.999 < r[1] < 1 and abs(r[2] - 0.5) < 0.01
    assert spark.createDataFrame([(None,), (0,)], "id long").select(src.splitmix64(0, "id").alias("v")).where("v IS NULL").count() == 1
    k = src.random_keys(spark, 500, 3, 7)
    assert k.where(mk.level("key") != 7).count() == 0 and k.where("key IS NULL").count() == 0 and k.select("key").distinct().count() > 490
