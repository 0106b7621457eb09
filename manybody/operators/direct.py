"""All-pairs sums, the engine's yardstick: every target against every source, in blocks.

Coincident pairs add nothing. Kernels, w = x - y, R = |w|, without 1/(4 pi):
charges q/R, dipoles d.w/R^3, Yukawa q e^{-kR}/R, Helmholtz q e^{ikR}/R.
Targets and sources are packed in rows of points; pairs of packs go to tasks, where
NumPy sums them tile by tile, so no row is made for a pair and memory is bounded. The
cost is the product of the row counts: for all targets of large tables use the tree engine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the smaller side that may be broadcast (64 bytes each).
BROADCAST_ROWS = 500_000
#: Points of a pack of targets and of sources; TILE sources are compared with a pack of targets at once.
TARGETS, SOURCES, TILE = 256, 4096, 64  # arrays of a tile stay in a core's cache


def _packed(points: DataFrame, ids: bool, columns: list[str], size: int) -> DataFrame:
    """Points without nulls as rows of at most size points: ids (if asked for) and the columns' values, as bytes."""
    names = ["ids", "at"] if ids else ["s"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                values = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in columns])
                row = [values.tobytes()]
                if ids:
                    row = [part.column("point_id").to_numpy(zero_copy_only=False).tobytes(), *row]
                yield pa.record_batch([pa.array([v], pa.binary()) for v in row], names=names)

    p = points.select(*(["point_id"] if ids else []), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    return p.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def sums(targets: DataFrame, sources: DataFrame, parameters: list[str], outputs: list[str], kernel) -> DataFrame:
    """point_id and outputs: the sums of kernel(d, r, inv, s) over all sources; a target that meets no source has zeros.

    d has the differences by axis, r and inv the distances and their inverses (0 where points
    coincide) of a tile of pairs, s the sources' parameters; kernel returns a sum a target for each output.
    """
    spark = targets.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # a row of two packs has about 100 KB
    targets = targets.select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z")
    n = sources.count()
    s = _packed(sources, False, ["x", "y", "z", *parameters], SOURCES)
    s = F.broadcast(s) if n <= BROADCAST_ROWS else s.repartition(-(-n // BROADCAST_ROWS))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = _packed(targets, True, ["x", "y", "z"], TARGETS).repartition(4 * tasks).crossJoin(s)  # packs dealt in turn
    width = 3 + len(parameters)

    def run(batches):
        held = None  # the pack of targets that may go on: its bytes and sums

        def rows():
            return pa.record_batch([pa.array(np.frombuffer(held[0], np.int64)), *map(pa.array, held[2])], names=["point_id", *outputs])

        for b in batches:
            for ids, at, s in zip(*(b.column(c) for c in ("ids", "at", "s")), strict=True):
                ids, at = ids.as_py(), at.as_py()
                if held is None or held[:2] != (ids, at):
                    if held is not None:
                        yield rows()
                    held = (ids, at, np.zeros((len(outputs), len(ids) // 8)))
                x = np.frombuffer(at).reshape(3, -1)
                y = np.frombuffer(s.as_buffer()).reshape(width, -1)
                for lo in range(0, y.shape[1], TILE):
                    part = y[:, lo : lo + TILE]
                    d = [x[a][:, None] - part[a] for a in range(3)]
                    r = d[0] * d[0]
                    r += d[1] * d[1]
                    r += d[2] * d[2]
                    same = r == 0 if r.min() == 0 else None
                    np.sqrt(r, out=r)
                    with np.errstate(divide="ignore"):
                        inv = 1 / r
                    if same is not None:
                        inv[same] = 0
                    for out, v in zip(held[2], kernel(d, r, inv, part[3:]), strict=True):
                        out += v
        if held is not None:
            yield rows()

    got = both.mapInArrow(run, ", ".join(["point_id long", *[f"{c} double" for c in outputs]]))
    got = got.groupBy("point_id").agg(*[F.sum(c).alias(c) for c in outputs])
    return targets.select("point_id").join(got, "point_id", "left").select("point_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in outputs])


def laplace(targets: DataFrame, sources: DataFrame, gradients: bool = False, scale: float = 1 / (4 * math.pi)) -> DataFrame:
    """point_id, phi (and gx, gy, gz) of charges q."""

    def kernel(d, r, inv, s):
        q = s[0] * scale
        out = [inv @ q]
        if gradients:
            inv = inv * inv * inv
            out += [-(inv * v) @ q for v in d]
        return out

    return sums(targets, sources, ["q"], ["phi", "gx", "gy", "gz"] if gradients else ["phi"], kernel)


def dipoles(targets: DataFrame, sources: DataFrame, gradients: bool = False, scale: float = 1 / (4 * math.pi)) -> DataFrame:
    """point_id, phi (and gradient) of dipole moments mx, my, mz."""

    def kernel(d, r, inv, s):
        m = s * scale
        inv2 = inv * inv
        inv3 = inv2 * inv
        dot = (d[0] * m[0] + d[1] * m[1] + d[2] * m[2]) * inv3
        out = [dot.sum(axis=1)]
        if gradients:
            dot *= 3 * inv2
            out += [inv3 @ m[a] - np.einsum("ij,ij->i", dot, d[a]) for a in range(3)]
        return out

    return sums(targets, sources, ["mx", "my", "mz"], ["phi", "gx", "gy", "gz"] if gradients else ["phi"], kernel)


def yukawa(targets: DataFrame, sources: DataFrame, kappa: float, gradients: bool = False, scale: float = 1 / (4 * math.pi)) -> DataFrame:
    def kernel(d, r, inv, s):
        q = s[0] * scale
        e = r * -kappa
        np.exp(e, out=e)
        e *= inv
        out = [e @ q]
        if gradients:
            e *= (kappa * r + 1) * inv * inv
            out += [-(e * v) @ q for v in d]
        return out

    return sums(targets, sources, ["q"], ["phi", "gx", "gy", "gz"] if gradients else ["phi"], kernel)


_STEP = 2 * math.pi / 1024
_COS, _SIN = np.cos(np.arange(1024) * _STEP), np.sin(np.arange(1024) * _STEP)


def _cos_sin(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines in double precision: a table of 1024 angles, turned by what is left (less than 0.0031) by its series."""
    n = z * (1 / _STEP)
    np.rint(n, out=n)
    at = n.astype(np.int64)
    at &= 1023
    n *= -_STEP
    n += z
    c, s = _COS.take(at, mode="clip"), _SIN.take(at, mode="clip")
    z2 = n * n
    dc = z2 * (1 / 24)
    dc -= 0.5
    dc *= z2  # cos - 1
    z2 *= z2 * (1 / 120) - 1 / 6
    z2 += 1
    z2 *= n  # sin
    n = c * z2
    z2 *= s
    s += s * dc
    s += n
    dc *= c
    dc -= z2
    c += dc
    return c, s


def helmholtz(targets: DataFrame, sources: DataFrame, k_re: float, k_im: float = 0.0, gradients: bool = False, scale: float = 1 / (4 * math.pi)) -> DataFrame:
    """point_id, phi_re, phi_im (and gx_re, gx_im, ...) of complex charges q_re, q_im (q_im may be absent)."""
    if "q_im" not in sources.columns:
        sources = sources.withColumn("q_im", F.lit(0.0))

    def kernel(d, r, inv, s):
        q, p = s * scale
        c, s = _cos_sin(k_re * r)
        e = inv
        if k_im:
            e = r * -k_im
            np.exp(e, out=e)
            e *= inv
        c *= e
        s *= e
        out = [c @ q - s @ p, s @ q + c @ p]
        if gradients:
            a, b, inv = -k_im * r - 1, k_re * r, inv * inv  # i k R - 1
            c, s = (a * c - b * s) * inv, (a * s + b * c) * inv
            for v in d:
                out += [(c * v) @ q - (s * v) @ p, (s * v) @ q + (c * v) @ p]
        return out

    return sums(targets, sources, ["q_re", "q_im"], [f"{n}_{c}" for n in (("phi", "gx", "gy", "gz") if gradients else ("phi",)) for c in ("re", "im")], kernel)


def relative_l2(got: DataFrame, want: DataFrame, columns: list[str]) -> float:
    """sqrt(sum |got - want|^2 / sum |want|^2) over point_id; a missing row or value is an error."""
    from . import metrics

    return metrics.error_of(got, want, columns).first()["relative_l2"]
