import random

from manybody.functions import morton as mk
from pyspark.sql import functions as F


def enc(i, j, k, lev):
    key = 0
    for b in range(16):
        for a, v in enumerate((i, j, k)):
            key |= ((v << (16 - lev)) >> b & 1) << (3 * b + 2 - a)
    return key << 15 | lev


def test_algebra(spark):
    r = random.Random(1)
    rows = []
    for n in range(150):
        lev = r.choice([0, 1, 2, 3, 8, 15, 16])
        at = [r.choice([0, (1 << lev) - 1, r.randrange(1 << lev)]) for _ in range(3)]
        l2 = r.choice([max(0, lev - 1), lev, min(16, lev + 1)])
        b = [min((1 << l2) - 1, max(0, (v << l2 >> lev) + r.choice([-1, 0, 0, 1, 2]))) for v in at]
        rows.append((n, lev, *at, l2, *b))
    df = spark.createDataFrame(rows, "n int, l int, i long, j long, k long, l2 int, p long, q long, s long")
    df = df.withColumn("key", mk.encode("i", "j", "k", "l")).withColumn("other", mk.encode("p", "q", "s", "l2")).cache()
    out = df.select("*", mk.decode("key").alias("d"), mk.parent("key").alias("up"), mk.octant("key").alias("o"), mk.children("key").alias("kids"), mk.neighbours("key").alias("near"), mk.adjacent("key", "other").alias("adj"),
                    mk.last_descendant("key").alias("last"), mk.next_outside("key").alias("next"), mk.common_ancestor("key", "other").alias("lca"), mk.shifted("key", 1, F.lit(-2), 0).alias("moved"), mk.is_well_formed("key").alias("ok"), mk.is_ancestor("other", "key").alias("anc"))
    for x in out.collect():
        lev, at = x.l, (x.i, x.j, x.k)
        assert x.key == enc(*at, lev) and tuple(x.d) == (lev, *at) and x.ok
        assert x.up == (enc(*(v >> 1 for v in at), lev - 1) if lev else None)
        assert x.o == ((at[0] & 1) * 4 + (at[1] & 1) * 2 + (at[2] & 1) if lev else None)
        assert x.kids == (None if lev == 16 else [enc(*(2 * v + (o >> s & 1) for v, s in zip(at, (2, 1, 0))), lev + 1) for o in range(8)])
        inside = lambda v: all(0 <= u < 1 << lev for u in v)
        near = [tuple(a + b for a, b in zip(at, d)) for d in mk.OFFSETS]
        assert x.near == [enc(*v, lev) for v in near if inside(v)]
        m = tuple(a + b for a, b in zip(at, (1, -2, 0)))
        assert x.moved == (enc(*m, lev) if inside(m) else None)
        size, s2 = 1 << (16 - lev), 1 << (16 - x.l2)
        lo, lo2 = [v * size for v in at], [v * s2 for v in (x.p, x.q, x.s)]
        holds = lambda a, n, b, k: n >= k and all(u <= v < u + n for u, v in zip(a, b))
        touch = all(u <= v + s2 and v <= u + size for u, v in zip(lo, lo2))
        assert x.adj == (touch and not holds(lo, size, lo2, s2) and not holds(lo2, s2, lo, size))
        assert x.anc == holds(lo2, s2, lo, size)
        assert x.last == enc(*(v + size - 1 for v in lo), 16)
        digits = (x.last >> 15) + 1
        assert x.next == (digits << 15 | 16 if digits < 1 << 48 else None)
        lca = max(g for g in range(min(lev, x.l2) + 1) if all(u >> (16 - g) == v >> (16 - g) for u, v in zip(lo, lo2)))
        assert x.lca == enc(*(u >> (16 - lca) for u in lo), lca)
    assert mk.UPPER_BOUND > mk.DEEPEST_LAST == enc(65535, 65535, 65535, 16)
