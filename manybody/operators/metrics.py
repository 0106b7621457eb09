"""Errors of results against references, as mergeable aggregates.

A state is a struct of sums and maxima (n, diff2, norm2, worst, largest): states of
parts add up to the state of the whole, so errors are partial aggregates like any sum
and can be kept (as JSON) and merged later.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import direct

STATE = "struct<n:long,diff2:double,norm2:double,worst:double,largest:double>"


def compared(got: DataFrame, want: DataFrame, columns: list[str], key: str = "point_id") -> DataFrame:
    """Rows of both by key: diff2 and norm2, the squared lengths of the difference and of the reference over the columns.

    A vector, or the real and imaginary part of a number, is several columns. A key that
    only one side has, or a null value, is an error: nothing may be missing from a norm.
    """
    g = got.select(F.col(key), *[F.col(c).cast("double").alias(f"g_{c}") for c in columns])
    w = want.select(F.col(key), *[F.col(c).cast("double").alias(f"w_{c}") for c in columns])
    both = g.join(w, key, "full")
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(f"g_{c}").isNull() | F.col(f"w_{c}").isNull()
    fail = F.when(missing, F.raise_error(F.lit("a result or a reference is missing")).cast("double"))
    square = lambda parts: sum((x * x for x in parts), F.lit(0.0))
    return both.select(
        key,
        F.coalesce(fail, square([F.col(f"g_{c}") - F.col(f"w_{c}") for c in columns])).alias("diff2"),
        square([F.col(f"w_{c}") for c in columns]).alias("norm2"),
    )


def state() -> Column:
    """Aggregate of rows(diff2, norm2): their state."""
    return F.struct(F.count("*").alias("n"), F.sum("diff2").alias("diff2"), F.sum("norm2").alias("norm2"), F.sqrt(F.max("diff2")).alias("worst"), F.sqrt(F.max("norm2")).alias("largest"))


def merged(name: str = "state") -> Column:
    """Aggregate of states: the state of all their rows."""
    s = F.col(name)
    return F.struct(F.sum(s["n"]).alias("n"), F.sum(s["diff2"]).alias("diff2"), F.sum(s["norm2"]).alias("norm2"), F.max(s["worst"]).alias("worst"), F.max(s["largest"]).alias("largest"))


def serialised(s: Column) -> Column:
    return F.to_json(s)


def deserialised(s: Column) -> Column:
    return F.from_json(s, STATE)


def relative(s: Column) -> Column:
    """Relative L2 error of a state: infinite if the reference is 0 and the result is not."""
    return F.when(s["norm2"] > 0, F.sqrt(s["diff2"] / s["norm2"])).when(s["diff2"] > 0, F.lit(float("inf"))).otherwise(0.0)


def error_of(got: DataFrame, want: DataFrame, columns: list[str], key: str = "point_id") -> DataFrame:
    """One row: n, relative_l2, max_error."""
    s = compared(got, want, columns, key).agg(state().alias("s"))
    return s.select(F.col("s.n").alias("n"), relative(F.col("s")).alias("relative_l2"), F.col("s.worst").alias("max_error"))


def magnitudes(targets: DataFrame, sources: DataFrame, scale: float = 1 / (4 * math.pi), potentials: bool = False) -> DataFrame:
    """point_id, m1 = sum |q|/r, m2 = sum |q|/r^2: what rounding errors of potentials and gradients are measured by.

    With potentials also phi = sum q/r, from the same pass over the pairs.
    """

    def kernel(d, r, inv, s):
        q = s[0] * scale
        size = np.abs(q)
        return [inv @ size, (inv * inv) @ size, *([inv @ q] if potentials else [])]

    return direct.sums(targets, sources, ["q"], ["m1", "m2", *(["phi"] if potentials else [])], kernel)


def scaled_error(got: DataFrame, want: DataFrame, columns: list[str], sizes: DataFrame, size: str) -> DataFrame:
    """One row: the largest error in units of the target's magnitude (m1 for potentials, m2 for gradients)."""
    rows = compared(got, want, columns).join(sizes.select("point_id", size), "point_id")
    return rows.agg(F.max(F.when(F.col(size) > 0, F.sqrt("diff2") / F.col(size)).otherwise(F.sqrt("diff2"))).alias("scaled_error"))


def degree_norms(expansions: DataFrame) -> DataFrame:
    """expansions(key, c) as key, n, norm: per degree n the root of the orders' squares, those with m not 0 twice (they stand for -m too)."""
    rows = expansions.select("key", F.posexplode("c").alias("i", "v")).withColumn("n", F.floor(F.sqrt("i")).cast("int"))
    twice = F.when(F.col("i") == F.col("n") * F.col("n") + F.col("n"), 1.0).otherwise(2.0)
    return rows.groupBy("key", "n").agg(F.sqrt(F.sum(twice * F.col("v") * F.col("v"))).alias("norm"))


def degree_errors(got: DataFrame, want: DataFrame) -> DataFrame:
    """key, n, error: per degree the norm of the difference over the reference's (absolute where that is 0)."""
    diff = got.withColumnRenamed("c", "g").join(want.withColumnRenamed("c", "w"), "key").select("key", F.zip_with("g", "w", lambda a, b: a - b).alias("c"))
    size = degree_norms(want).withColumnRenamed("norm", "size")
    return degree_norms(diff).join(size, ["key", "n"]).select("key", "n", F.when(F.col("size") > 0, F.col("norm") / F.col("size")).otherwise(F.col("norm")).alias("error"))


def worst_degree(errors: DataFrame) -> DataFrame:
    """key, n, error of the largest error; of equal ones the lowest degree."""
    return errors.groupBy("key").agg(F.max(F.struct("error", (-F.col("n")).alias("m"))).alias("x")).select("key", (-F.col("x.m")).alias("n"), F.col("x.error").alias("error"))


def checksum(results: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """One row: n and the XOR of the rows' hashes, which depends on neither order nor partitioning; values are rounded first."""
    return results.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*[F.round(F.col(c), digits) if t in ("double", "float") else F.col(c) for c, t in results.dtypes if c in columns])).alias("checksum"))


def box_errors(rows: DataFrame, key: str) -> DataFrame:
    """rows(diff2, norm2, <key>) by box: n, rms (root of the mean squared error), relative_l2."""
    s = rows.groupBy(key).agg(state().alias("s"))
    return s.select(key, F.col("s.n").alias("n"), F.sqrt(F.col("s.diff2") / F.col("s.n")).alias("rms"), relative(F.col("s")).alias("relative_l2"))


def worst_boxes(boxes: DataFrame, key: str, k: int) -> DataFrame:
    """The k boxes of largest relative error, ties by key."""
    return boxes.orderBy(F.desc("relative_l2"), key).limit(k)


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, least, median, mean, most and sample deviation of a column, by groups."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("deviation"))
