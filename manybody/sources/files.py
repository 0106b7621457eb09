"""Files: problem files in a flat binary layout, and octrees for viewers."""

from __future__ import annotations

import math
import os
import struct
import uuid
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the first eight bytes of a problem file.
MAGIC = b"NDFMMPB1"
HEADER = struct.Struct("<8s5Q")


def write_problem(path: str, points: np.ndarray, charges: np.ndarray, sample: np.ndarray, reference: np.ndarray, seed: int = 0, distribution: int = 0) -> None:
    """N x 3 points, N x m charges, s sampled rows, s x m x 4 reference values, behind a header of N, m, s, seed, distribution."""
    n, m = charges.shape
    with open(path, "wb") as f:
        f.write(HEADER.pack(MAGIC, n, m, len(sample), seed, distribution))
        for a, kind in ((points, "<f8"), (charges, "<f8"), (sample, "<u8"), (reference, "<f8")):
            f.write(np.ascontiguousarray(a, kind).tobytes())


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problem files as rows: path, point_id, x, y, z, q (array), sampled, reference (array; null if not sampled)."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = raw.as_buffer()
                magic, n, m, s, _, _ = HEADER.unpack(bytes(raw[: HEADER.size]))
                if magic != MAGIC:
                    raise ValueError(f"{name} is no problem file")
                at = HEADER.size
                x = np.frombuffer(raw, "<f8", 3 * n, at).reshape(n, 3)
                q = np.frombuffer(raw, "<f8", n * m, at + 24 * n).reshape(n, m)
                rows = np.frombuffer(raw, "<u8", s, at + 8 * n * (3 + m)).astype(np.int64)
                ref = np.frombuffer(raw, "<f8", 4 * s * m, at + 8 * (n * (3 + m) + s)).reshape(s, 4 * m)
                place = {int(r): i for i, r in enumerate(rows)}
                for lo in range(0, n, 10_000):
                    ids = np.arange(lo, min(n, lo + 10_000))
                    hit = [place.get(int(i)) for i in ids]
                    yield pa.record_batch([pa.array([name] * len(ids)), pa.array(ids), *[pa.array(x[ids, a]) for a in range(3)], pa.array(list(q[ids]), pa.list_(pa.float64())), pa.array([h is not None for h in hit]), pa.array([None if h is None else ref[h] for h in hit], pa.list_(pa.float64()))], names=["path", "point_id", "x", "y", "z", "q", "sampled", "reference"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, point_id long, x double, y double, z double, q array<double>, sampled boolean, reference array<double>")


#: The first eight bytes of outputs at sampled targets and at all points, of wave problems and of their outputs.
OUTPUT_MAGIC, FULL_MAGIC = b"NDFMMOU1", b"NDFMMFU1"
WAVE_MAGIC, WAVE_OUTPUT_MAGIC, WAVE_FULL_MAGIC = b"NDFMMHP1", b"NDFMMHO1", b"NDFMMHF1"


def _replace(path: str, parts) -> None:
    """Writes the parts beside path and moves the file there when it is whole."""
    part = f"{path}.tmp"
    with open(part, "wb") as f:
        for x in parts:
            f.write(x)
    os.replace(part, path)


def write_output(path: str, results: DataFrame, vectors: int = 1, full: bool = True) -> int:
    """Potentials and gradients (phi, gx, gy, gz; phi0, gx0, ... for several vectors) in the order of point_id; returns the rows.

    Little-endian: magic, vectors, rows, then rows x vectors x 4 values. Rows stream through the driver.
    """
    names = [f"{c}{v}" if vectors > 1 else c for v in range(vectors) for c in ("phi", "gx", "gy", "gz")]
    rows = results.orderBy("point_id").select(*[F.col(c).cast("double") for c in names])
    if results.where(" OR ".join(f"{c} IS NULL" for c in names)).limit(1).count():
        raise ValueError("a result is null")
    n = results.count()
    head = struct.pack("<8s2Q", FULL_MAGIC if full else OUTPUT_MAGIC, vectors, n)
    _replace(path, (x for part in ([head], (struct.pack(f"<{len(names)}d", *r) for r in rows.toLocalIterator())) for x in part))
    return n


def _parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Files as rows: parse(name, buffer) yields record batches of schema."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield from parse(name, raw.as_buffer())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _values(name: str, first: int, values: np.ndarray) -> pa.RecordBatch:
    n = len(values)
    return pa.record_batch([pa.array([name] * n), pa.array(np.arange(first, first + n)), pa.array(list(values), pa.list_(pa.float64()))], names=["path", "row", "v"])


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Output files of both kinds: path, row, v (vectors x 4 values: phi and its gradient)."""

    def parse(name, raw):
        magic, m, n = struct.unpack("<8s2Q", bytes(raw[:24]))
        if magic not in (OUTPUT_MAGIC, FULL_MAGIC) or len(raw) != 24 + 32 * m * n:
            raise ValueError(f"{name} is no output file, or its length is wrong")
        values = np.frombuffer(raw, "<f8", 4 * m * n, 24).reshape(n, 4 * m)
        for lo in range(0, n, 10_000):
            yield _values(name, lo, values[lo : lo + 10_000])

    return _parsed(spark, path, parse, "path string, row long, v array<double>")


def compared_outputs(reference: DataFrame, other: DataFrame, vectors: int = 1) -> DataFrame:
    """One row: n, and phi_l2, phi_max, grad_l2, grad_max of two outputs' rows, each the root mean square over the vectors.

    A row that only one of them has is an error.
    """
    from ..operators import metrics

    split = lambda df: df.select("row", *[F.get("v", F.lit(4 * m + i)).alias(f"{c}{m}") for m in range(vectors) for i, c in enumerate("pxyz")])
    a, b = split(reference), split(other)
    out = None
    for m in range(vectors):
        for kind, names in (("phi", [f"p{m}"]), ("grad", [f"{c}{m}" for c in "xyz"])):
            one = metrics.error_of(b, a, names, key="row").select("n", F.lit(kind).alias("kind"), "relative_l2", "max_error")
            out = one if out is None else out.unionByName(one)
    rms = lambda k, c: F.sqrt(F.avg(F.when(F.col("kind") == k, F.col(c) * F.col(c))))
    return out.agg(F.max("n").alias("n"), *[rms(k, c).alias(f"{k}_{e}") for k in ("phi", "grad") for c, e in (("relative_l2", "l2"), ("max_error", "max"))])


def write_wave_problem(path: str, points: np.ndarray, charges: np.ndarray, sample: np.ndarray, seed: int = 0) -> None:
    """N x 3 points, N complex charges and s sampled rows behind a header of N, s, no further targets, and the seed."""
    head = struct.pack("<8s4q", WAVE_MAGIC, len(points), len(sample), 0, seed)
    _replace(path, [head, *(np.ascontiguousarray(a, k).tobytes() for a, k in ((points, "<f8"), (charges, "<c16"), (sample, "<i8")))])


def read_wave_problems(spark: SparkSession, path: str) -> DataFrame:
    """Wave problems as rows: path, point_id, x, y, z, q_re, q_im, sampled."""

    def parse(name, raw):
        magic, n, s, t, _ = struct.unpack("<8s4q", bytes(raw[:40]))
        if magic != WAVE_MAGIC or len(raw) != 40 + 40 * n + 8 * s + 24 * t:
            raise ValueError(f"{name} is no wave problem, or its length is wrong")
        x = np.frombuffer(raw, "<f8", 3 * n, 40).reshape(n, 3)
        q = np.frombuffer(raw, "<f8", 2 * n, 40 + 24 * n).reshape(n, 2)
        chosen = np.isin(np.arange(n), np.frombuffer(raw, "<i8", s, 40 + 40 * n))
        for lo in range(0, n, 10_000):
            at = slice(lo, lo + 10_000)
            ids = np.arange(n)[at]
            yield pa.record_batch([pa.array([name] * len(ids)), pa.array(ids), *[pa.array(v[at, i]) for v, k in ((x, 3), (q, 2)) for i in range(k)], pa.array(chosen[at])], names=["path", "point_id", "x", "y", "z", "q_re", "q_im", "sampled"])

    return _parsed(spark, path, parse, "path string, point_id long, x double, y double, z double, q_re double, q_im double, sampled boolean")


def write_wave_output(path: str, phi: np.ndarray, gradient: np.ndarray, full: bool = True) -> None:
    """All complex potentials (n), then all gradients (n x 3), at every source or at the sampled ones."""
    head = struct.pack("<8sq", WAVE_FULL_MAGIC, len(phi)) if full else struct.pack("<8s2q", WAVE_OUTPUT_MAGIC, len(phi), 0)
    _replace(path, [head, np.ascontiguousarray(phi, "<c16").tobytes(), np.ascontiguousarray(gradient, "<c16").tobytes()])


def read_wave_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Wave outputs of both kinds: path, row, v (re and im of the potential and of its gradient: 8 values).

    Values at further targets, which stand after those of the sampled ones, are not read.
    """

    def parse(name, raw):
        kind = bytes(raw[:8])
        if kind not in (WAVE_OUTPUT_MAGIC, WAVE_FULL_MAGIC):
            raise ValueError(f"{name} is no wave output")
        head = 24 if kind == WAVE_OUTPUT_MAGIC else 16
        n, more = (*struct.unpack(f"<{(head - 8) // 8}q", bytes(raw[8:head])), 0)[:2]
        if len(raw) != head + 64 * (n + more):
            raise ValueError(f"the length of {name} is wrong")
        phi = np.frombuffer(raw, "<f8", 2 * n, head).reshape(n, 2)
        grad = np.frombuffer(raw, "<f8", 6 * n, head + 16 * n).reshape(n, 6)
        for lo in range(0, n, 10_000):
            yield _values(name, lo, np.hstack([phi, grad])[lo : lo + 10_000])

    return _parsed(spark, path, parse, "path string, row long, v array<double>")


#: The cell arrays of tree files.
CELLS = (("UInt32", "refinement_level"), ("Int32", "owner_rank"), ("UInt64", "morton_key"))
_CORNERS = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)])


def _piece(rank: int, level: np.ndarray, keys: np.ndarray, low: np.ndarray, width: np.ndarray) -> bytes:
    """A grid of hexahedra, one a key."""
    n = len(keys)
    points = low[:, None, :] + _CORNERS * width[:, None, :]
    lines = lambda rows: "\n".join(" ".join(repr(v) for v in r) for r in rows)
    array = lambda kind, name, text, more="": f'<DataArray type="{kind}"{name and f' Name="{name}"'}{more} format="ascii">\n{text}\n</DataArray>'
    column = lambda v: "\n".join(map(str, v))
    cells = "".join(array(k, name, column(v)) for (k, name), v in zip(CELLS, (level.tolist(), [rank] * n, keys.tolist()), strict=True))
    return (
        f'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian"><UnstructuredGrid><Piece NumberOfPoints="{8 * n}" NumberOfCells="{n}">'
        f'<Points>{array("Float64", "", lines(points.reshape(-1, 3).tolist()), f" NumberOfComponents={chr(34)}3{chr(34)}")}</Points>'
        f'<Cells>{array("Int64", "connectivity", lines(np.arange(8 * n).reshape(n, 8).tolist()))}{array("Int64", "offsets", column(range(8, 8 * n + 1, 8)))}{array("UInt8", "types", column([12] * n))}</Cells>'
        f"<CellData>{cells}</CellData></Piece></UnstructuredGrid></VTKFile>\n"
    ).encode()


def pvtu(leaves: DataFrame, domain, folder: str, stem: str, parts: int) -> int:
    """Writes leaves(key) as ``parts`` pieces of key ranges, each by its task, and then the manifest; returns the number of leaves.

    folder must be one that all executors share. An older manifest goes first and the new
    one comes when all pieces are whole, so a failure leaves no manifest of mixed pieces;
    a task that runs again replaces its piece. An invalid key, a domain without volume and a
    stem that is no file name are errors.
    """
    from ..functions import morton as mk

    if not stem or stem in (".", "..") or any(c in "/\\" or ord(c) < 32 for c in stem):
        raise ValueError("stem must be a file name")
    if not all(math.isfinite(v) for v in domain) or min(domain[3:]) <= 0:
        raise ValueError("the domain must be finite and have a volume")
    manifest = os.path.join(folder, f"{stem}.pvtu")
    if os.path.exists(manifest):
        os.remove(manifest)
    bad = F.col("key").isNull() | ~mk.is_valid("key") | (mk.level("key") > mk.DEPTH)
    rows = leaves.select(F.when(bad, F.raise_error(F.lit("an invalid key")).cast("long")).otherwise(F.col("key")).alias("key"))
    rows = rows.select("key", mk.level("key").cast("long").alias("level"), mk.box("key", domain).alias("b")).select("key", "level", "b.*")
    ranged = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")

    def run(batches):
        from pyspark import TaskContext

        rank = TaskContext.get().partitionId()
        t = [b for b in batches if b.num_rows]
        col = lambda n, k: np.concatenate([b.column(n).to_numpy() for b in t]) if t else np.empty(0, k)
        keys = col("key", np.int64)
        low, width = (np.stack([col(f"{w}{a}", np.float64) for a in "xyz"], axis=1) for w in ("", "w"))
        path = os.path.join(folder, f"{stem}.rank{rank}.vtu")
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(_piece(rank, col("level", np.int64), keys, low, width))
        os.replace(own, path)
        yield pa.record_batch([pa.array([rank], pa.int32()), pa.array([len(keys)], pa.int64())], names=["rank", "n"])

    written = ranged.mapInArrow(run, "rank int, n long").collect()  # a row a piece
    name = escape(stem, {'"': "&quot;"})
    for rank in set(range(parts)) - {r.rank for r in written}:  # ranges that no key fell in
        none = np.empty(0, np.int64)
        _replace(os.path.join(folder, f"{stem}.rank{rank}.vtu"), [_piece(rank, none, none, np.empty((0, 3)), np.empty((0, 3)))])
    arrays = "".join(f'<PDataArray type="{k}" Name="{n}"/>' for k, n in CELLS)
    pieces = "".join(f'<Piece Source="{name}.rank{r}.vtu"/>' for r in range(parts))
    text = f'<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="1.0" byte_order="LittleEndian"><PUnstructuredGrid GhostLevel="0"><PPoints><PDataArray type="Float64" NumberOfComponents="3"/></PPoints><PCellData>{arrays}</PCellData>{pieces}</PUnstructuredGrid></VTKFile>\n'
    _replace(manifest, [text.encode()])
    return sum(r.n for r in written)


def vtu(leaves: DataFrame, domain, path: str) -> int:
    """Writes leaves(key) as an unstructured grid of hexahedra; rows stream through the driver. Returns their number."""
    from ..functions import morton as mk

    rows = leaves.select("key", mk.level("key").alias("level"), mk.box("key", domain).alias("b")).orderBy("key")
    corners = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
    n = rows.count()
    with open(path, "w") as f:
        f.write(f'<VTKFile type="UnstructuredGrid" version="1.0"><UnstructuredGrid><Piece NumberOfPoints="{8 * n}" NumberOfCells="{n}">\n<Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">\n')
        for r in rows.toLocalIterator():
            f.writelines(f"{r.b.x + i * r.b.wx!r} {r.b.y + j * r.b.wy!r} {r.b.z + k * r.b.wz!r}\n" for i, j, k in corners)
        f.write('</DataArray></Points>\n<Cells><DataArray type="Int64" Name="connectivity" format="ascii">\n')
        f.writelines(f"{' '.join(str(8 * c + v) for v in range(8))}\n" for c in range(n))
        f.write('</DataArray><DataArray type="Int64" Name="offsets" format="ascii">\n')
        f.writelines(f"{8 * c + 8}\n" for c in range(n))
        f.write('</DataArray><DataArray type="UInt8" Name="types" format="ascii">\n' + "12\n" * n + '</DataArray></Cells>\n<CellData>')
        for name, col in (("refinement_level", "level"), ("morton_key", "key")):
            f.write(f'<DataArray type="Int64" Name="{name}" format="ascii">\n')
            f.writelines(f"{r[0]}\n" for r in rows.select(F.col(col)).toLocalIterator())
            f.write("</DataArray>")
        f.write("</CellData></Piece></UnstructuredGrid></VTKFile>\n")
    return n
