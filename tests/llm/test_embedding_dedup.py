import math

import numpy as np
from manybody.llm import embedding_dedup as e


def brute(rows, threshold):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    root, links = {i: i for i, _ in rows if i is not None}, dict.fromkeys((i for i, _ in rows if i is not None), 0)
    width = max(map(len, ok.values()))
    m = np.stack([np.pad(ok[i], (0, width - len(ok[i]))) for i in ids])
    c = (m @ m.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) >= threshold

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for y, b in enumerate(ids):
            if x != y and c[x, y]:
                links[a] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, links[i], find(i), find(i) == i) for i in root}


def data(seed, n):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, 24)) * np.linspace(3, 0.2, 24)
    rows = [(int(i), [float(np.float32(v)) for v in base[r.integers(40)] + r.normal(size=24) * r.choice([0, 0.2, 0.6])]) for i in r.permutation(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(n, None), (n + 1, [0.0] * 24), (n + 2, [nan] + [1.0] * 23), (n + 3, [inf] * 24), (n + 4, [None] + [1.0] * 23), (n + 5, []), (n + 6, rows[0][1][:20]), (None, rows[0][1])]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "TILE", 60)
    for kind in ("float", "double"):
        rows = data(4, 500)
        got = e.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), 0.9).collect()
        assert len(got) == len(rows)
        assert {tuple(r) for r in got if r.vec_id is not None} == brute(rows, 0.9)
        assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, False)]


def test_real_table_and_empty(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    assert {tuple(r) for r in e.op1_embedding_dedup(spark, "/root/testdata/sf0.001").collect()} == brute(rows, 0.9)
    assert e.near_duplicates(t.where("false")).count() == 0
    assert e.near_duplicates(t.selectExpr("vec_id", "cast(null as array<float>) as embedding", "1 as rep", "2 as comp")).where("kept").count() == len(rows)


def test_tiles_are_written_once(spark, monkeypatch):
    """The pairs of tiles are pairs of paths: the comparison's input holds no vectors, however many pairs a tile is in."""
    import numpy as np
    from manybody.llm import embedding_dedup as op

    seen = []
    kept = op.materialise

    def watched(df, name):
        if name == "found":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            seen.append("embedding#" in plan or "binary" in plan or "ma#" in plan)
        return kept(df, name)

    monkeypatch.setattr(op, "materialise", watched)
    monkeypatch.setattr(op, "TILE", 16)
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)], "vec_id long, embedding array<float>")
    got = {v.vec_id: v.n_links for v in op.near_duplicates(rows, 0.9).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == {i: int(n) for i, n in enumerate((u @ u.T >= 0.9).sum(axis=1) - 1)} and seen == [False]
