"""Point sources: seeded generators whose row i depends on (seed, i) only, and points of tables.

Any task can make any row, so the result doesn't depend on the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morton as mk


def uniform(seed: int, salt: int, row: Column | str = "point_id") -> Column:
    """A number in [0, 1) from a hash of (seed, salt, row): 53 bits."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), F.col(row) if isinstance(row, str) else row)
    return F.shiftrightunsigned(h, 11) / float(1 << 53)


#: The increment and the two multipliers of the SplitMix64 generator (Steele, Lea and Flood, 2014).
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(seed: int, row: Column | str = "point_id") -> Column:
    """Output number row (from 0) of the generator with a seed, as the signed long of its 64 bits; null rows give null.

    The generator's state is a multiple of its increment, so any row is made alone, by batches of numbers.
    """

    @F.pandas_udf("long")
    def bits(rows: pd.Series) -> pd.Series:
        known = rows.notna().to_numpy()
        z = np.uint64(seed % 2**64) + (rows.fillna(0).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64)).astype("Int64").where(known)

    return bits(F.col(row) if isinstance(row, str) else row)


def splitmix_uniform(seed: int, row: Column | str = "point_id") -> Column:
    """Its numbers in [0, 1), from the top 53 bits."""
    return F.shiftrightunsigned(splitmix64(seed, row), 11) / float(1 << 53)


def random_keys(spark: SparkSession, n: int, seed: int = 1, level: int = mk.DEPTH) -> DataFrame:
    """n uniform keys of a level: point_id, key; keys may repeat."""
    at = [F.floor(uniform(seed, i) * (1 << level)) for i in range(3)]
    return _rows(spark, n, key=mk.encode(*at, F.lit(level)))


def normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, salt))) * F.cos(2 * math.pi * uniform(seed, salt + 1))


def _rows(spark: SparkSession, n: int, **columns) -> DataFrame:
    df = spark.range(n).withColumnRenamed("id", "point_id")
    return df.select("point_id", *[c.alias(k) for k, c in columns.items()])


def cube(spark, n: int, seed: int = 1, centre=(0.0, 0.0, 0.0), half_width: float = 1.0) -> DataFrame:
    return _rows(spark, n, **{a: F.lit(centre[i]) + half_width * (2 * uniform(seed, i) - 1) for i, a in enumerate("xyz")})


def _direction(seed: int, salt: int) -> list[Column]:
    z, f = 2 * uniform(seed, salt) - 1, 2 * math.pi * uniform(seed, salt + 1)
    s = F.sqrt(1 - z * z)
    return [s * F.cos(f), s * F.sin(f), z]


def ball(spark, n: int, seed: int = 1, centre=(0.0, 0.0, 0.0), radius: float = 1.0) -> DataFrame:
    r = radius * F.pow(uniform(seed, 9), F.lit(1 / 3))
    return _rows(spark, n, **{a: F.lit(centre[i]) + r * d for i, (a, d) in enumerate(zip("xyz", _direction(seed, 3), strict=True))})


def sphere(spark, n: int, seed: int = 1, centre=(0.0, 0.0, 0.0), radius: float = 1.0) -> DataFrame:
    return _rows(spark, n, **{a: F.lit(centre[i]) + radius * d for i, (a, d) in enumerate(zip("xyz", _direction(seed, 3), strict=True))})


def plummer(spark, n: int, seed: int = 1, centre=(0.0, 0.0, 0.0), scale: float = 0.1) -> DataFrame:
    """Plummer's density, cut at ten scale lengths: the radius by the inverse of its distribution."""
    most = (1 + 0.01) ** -1.5
    r = scale / F.sqrt(F.pow(F.greatest(uniform(seed, 9), F.lit(1e-12)) * most, F.lit(-2 / 3)) - 1)
    return _rows(spark, n, **{a: F.lit(centre[i]) + r * d for i, (a, d) in enumerate(zip("xyz", _direction(seed, 3), strict=True))})


def clusters(spark, n: int, centres: list[tuple[float, float, float]], width: float = 0.02, seed: int = 1) -> DataFrame:
    """Gaussian clusters; a component beyond four widths is drawn again (up to eight times: one in 10^33 is then at the centre)."""
    which = F.floor(uniform(seed, 99) * len(centres)).cast("int")
    at = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centres])
    inside = lambda i: F.coalesce(*[F.when(F.abs(z) <= 4, z) for z in (normal(seed, 20 + 2 * i + 100 * turn) for turn in range(8))], F.lit(0.0))
    return _rows(spark, n, **{a: F.get(F.get(at, which), F.lit(i)) + width * inside(i) for i, a in enumerate("xyz")})


def fibonacci_sphere(spark, n: int, radius: float = 0.5) -> DataFrame:
    """Evenly spread points of a sphere, in closed form."""
    i = F.col("point_id") + 0.5
    z = 1 - 2 * i / n
    f = i * (math.pi * (3 - math.sqrt(5)))
    s = F.sqrt(1 - z * z)
    return _rows(spark, n, x=radius * s * F.cos(f), y=radius * s * F.sin(f), z=radius * z)


def with_charges(points: DataFrame, vectors: int = 1, seed: int = 7, dipoles: bool = False) -> DataFrame:
    """Charges q (or q0, q1, ...) and moments, uniform in [-1, 1)."""
    for v in range(vectors):
        points = points.withColumn("q" if vectors == 1 else f"q{v}", 2 * uniform(seed, 50 + v) - 1)
    for i, a in enumerate("xyz" if dipoles else ""):
        points = points.withColumn(f"m{a}", 2 * uniform(seed, 40 + i) - 1)
    return points


def sample(points: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """n distinct rows, the same for any partitioning."""
    return points.orderBy(F.xxhash64(F.lit(seed), F.col("point_id")), "point_id").limit(n)


#: Multipliers and modulus of the points that a table's keys give.
LCG, PRIME = (73856093, 19349663, 83492791), 65521


def of_keys(table: DataFrame, key: str) -> DataFrame:
    """Points in [0, 1)^3 and charges +1 and -1 from integer keys, by integer arithmetic alone."""
    k = F.col(key).cast("long")
    return table.select(k.alias("point_id"), k.alias("source_id"), *[(F.pmod(k * m, F.lit(PRIME)) / float(PRIME)).alias(a) for a, m in zip("xyz", LCG, strict=True)], (1 - 2 * F.pmod(k, F.lit(2))).cast("double").alias("q"))


def of_embeddings(table: DataFrame) -> DataFrame:
    """The first three components as points, label - 4.5 as charge."""
    return table.select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("source_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")], (F.col("label") - 4.5).alias("q"))
