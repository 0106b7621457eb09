"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Vectors are scaled to length 1 and turned into principal axes, largest variance
first. A kd-tree of a bounded sample cuts the space into at most MAX_LEAVES boxes;
two boxes farther apart than the threshold's chord share no link. Tiles of the
other pairs are compared block by block: the products of the leading axes are
summed first, the rest is bounded by the product of the suffix norms, and a pair
is dropped as soon as it cannot reach the threshold. What is left is decided by
the cosine of the vectors as given, in double precision.

Each tile is one file in the shared work folder; the tasks get pairs of paths and read
the tiles themselves, so what is written and shuffled grows with the rows, not with the pairs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, new_path, small_batches, table
from .sstable import _file_system

TILE = 4096
MAX_LEAVES, SAMPLE = 2048, 20_000
BOX_DIMS = 8
#: Slack of the bounds for rounding; the last test has none.
SLACK = 1e-9
BLOCK = 256


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.float64)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """A kd-tree over the leading axes: nodes (axis, cut), children 2i+1 and 2i+2; leaves are numbered 0..2^depth-1."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.axis, self.cut = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        rows = {0: sample}
        for i in range((1 << self.depth) - 1):
            part = rows.pop(i)
            k = int(np.argmax(part.var(axis=0))) if len(part) else 0
            c = float(np.median(part[:, k])) if len(part) else 0.0
            self.axis[i], self.cut[i] = k, c
            rows[2 * i + 1], rows[2 * i + 2] = part[part[:, k] <= c], part[part[:, k] > c]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])
        return at - ((1 << self.depth) - 1)


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float):
    """Blocks of pairs (i, j) of rows of x and y whose cosine is at least the threshold."""
    p, q = unit(x) @ axes, unit(y) @ axes
    dims = p.shape[1]
    steps = sorted({min(d, dims) for d in (8, 16, 32)} | {dims})
    suffix = lambda m: [np.sqrt(np.maximum(0, (m[:, d:] ** 2).sum(axis=1))) for d in steps]
    sp, sq = suffix(p), suffix(q)
    nx, ny = np.abs(x).max(axis=1), np.abs(y).max(axis=1)
    for lo in range(0, len(p), BLOCK):
        part = p[lo : lo + BLOCK]
        s = part[:, : steps[0]] @ q[:, : steps[0]].T
        i, j = np.nonzero(s + sp[0][lo : lo + BLOCK, None] * sq[0] >= threshold - SLACK)
        s = s[i, j]
        for k, (a, b) in enumerate(zip(steps[:-1], steps[1:], strict=True), 1):
            if len(i) > 0.2 * len(part) * len(q):  # most are alive: a whole block is faster
                s = s + (part[:, a:b] @ q[:, a:b].T)[i, j]
            else:
                s = s + np.einsum("ij,ij->i", part[i, a:b], q[j, a:b])
            on = s + sp[k][lo + i] * sq[k][j] >= threshold - SLACK
            i, j, s = i[on], j[on], s[on]
        if len(i):
            u, v = x[lo + i] / nx[lo + i, None], y[j] / ny[j, None]
            on = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v))) >= threshold
            yield lo + i[on], j[on]


def _write_tile(path: str, ids: np.ndarray, copies: np.ndarray, m: np.ndarray) -> None:
    """A tile as a file: the number of rows, ids, copies, components."""
    fs, p = _file_system(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as out:
        for part in (np.array([len(ids)], np.int64), ids, copies, m):
            out.write(np.ascontiguousarray(part).tobytes())


def _read_tile(path: str, kind: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fs, p = _file_system(path)
    with fs.open_input_stream(p) as f:
        data = f.read()
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, copies = np.frombuffer(data, np.int64, 2 * n, 8).reshape(2, n)
    return ids, copies, np.frombuffer(data, kind, -1, 8 + 16 * n).reshape(n, dim).astype(np.float64)


def _compare(axes: np.ndarray, threshold: float, dim: int, kind: str):
    """Rows of two tiles' paths (a, b) to rows (vec, other, links): partial counts, and a spanning forest of the links (other not null)."""

    def run(batches):
        at, left = None, None  # the last first tile is kept
        for b in batches:
            for first, second in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                same = first == second
                if first != at:
                    at, left = first, _read_tile(first, kind, dim)
                right = left if same else _read_tile(second, kind, dim)
                ids, copies = (left[0], right[0]), (left[1], right[1])
                x, y = left[2], right[2]
                base = 0 if same else len(x)
                root = np.arange(base + len(y))
                links = np.zeros(len(root), np.int64)
                for i, j in linked(x, y, axes, threshold):
                    if same:
                        i, j = i[i != j], j[i != j]
                    np.add.at(links, i, copies[1][j])
                    if not same:
                        np.add.at(links, base + j, copies[0][i])
                    j = base + j
                    while True:  # least labels along the links, until they agree
                        a, c = root[i], root[j]
                        if (a == c).all():
                            break
                        low = np.minimum(a, c)
                        np.minimum.at(root, a, low)
                        np.minimum.at(root, c, low)
                        while (root[root] != root).any():
                            root = root[root]
                every = ids[0] if same else np.concatenate(ids)
                on, tree = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
                vec = np.concatenate([every[on], every[tree]])
                other = pa.array(np.concatenate([np.zeros(len(on), np.int64), every[root[tree]]]), mask=np.arange(len(vec)) < len(on))
                yield pa.record_batch([pa.array(vec), other, pa.array(np.concatenate([links[on], np.zeros(len(tree), np.int64)]))], names=["vec", "other", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """A row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, and so do rows without vec_id (their component is null). Shorter
    vectors count as filled up with zeros. Equal vectors are one node with a number
    of copies. threshold must be positive.
    """
    spark = vectors.sparkSession
    kind = "double" if dict(vectors.dtypes)["embedding"] == "array<double>" else "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    good = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    n, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    def scatter(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            u = unit(_matrix(b.column("embedding"), dim))
            total += u.T @ u
        yield pa.record_batch([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "v"])

    small_batches(spark, 2048)
    sums = classes.select("embedding").mapInArrow(scatter, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    square = np.zeros(dim * dim)
    square[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    axes = np.linalg.eigh(square.reshape(dim, dim))[1][:, ::-1].copy()
    lead = min(dim, BOX_DIMS)
    share = min(1.0, SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").limit(2 * SAMPLE).toArrow()
    tree = Tree((unit(_matrix(sample.column("embedding"), dim)) @ axes)[:, :lead], min(MAX_LEAVES, -(-n // TILE)))

    def assign(batches):
        for b in batches:
            p = (unit(_matrix(b.column("embedding"), dim)) @ axes)[:, :lead]
            yield pa.record_batch([b.column("rep"), b.column("copies"), b.column("embedding"), pa.array(tree.leaf(p)), pa.FixedSizeListArray.from_arrays(p.ravel(), lead).cast(pa.list_(pa.float64()))], names=["rep", "copies", "embedding", "leaf", "p"])

    placed = materialise(classes.select("rep", "copies", "embedding").mapInArrow(assign, f"rep long, copies long, embedding array<{kind}>, leaf long, p array<double>"), "placed")
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.col("p")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(lead)]).orderBy("leaf").collect()  # at most MAX_LEAVES rows
    low, high = (np.array([[b[f"{f}{k}"] for k in range(lead)] for b in boxes]) for f in ("min", "max"))
    parts = [-(-b["n"] // TILE) for b in boxes]
    near = []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
        near += [(i, i + int(j)) for j in np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * threshold + SLACK)]
    name = {b["leaf"]: k for k, b in enumerate(boxes)}
    number = F.element_at(F.create_map(*[F.lit(x) for k, v in name.items() for x in (k, v)]), F.col("leaf"))
    split = F.element_at(F.create_map(*[F.lit(x) for k, v in name.items() for x in (k, parts[v])]), F.col("leaf"))
    tiled = placed.select(F.concat_ws("-", number, F.pmod(F.xxhash64("rep", F.lit(3)), split)).alias("t"), "rep", "copies", "embedding")

    base = new_path(spark, "tiles")

    def pack(key, t):
        m = _matrix(t.column("embedding"), dim).astype(np.float64 if kind == "double" else np.float32)
        path = f"{base}/{key[0].as_py()}-{uuid.uuid4().hex}"  # an attempt's own: the row that counts names it
        _write_tile(path, t.column("rep").to_numpy(), t.column("copies").to_numpy(), m)
        return pa.table({"t": [key[0].as_py()], "path": [path]})

    tiles = materialise(tiled.groupBy("t").applyInArrow(pack, "t string, path string"), "paths")  # about TILE rows a group
    pairs = spark.createDataFrame([(i, j, parts[i], parts[j]) for i, j in near], "i int, j int, x int, y int")
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("u")).select("*", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("v")).where("i < j OR u <= v").select(F.concat_ws("-", "i", "u").alias("ta"), F.concat_ws("-", "j", "v").alias("tb"))
    side = lambda c: tiles.select(F.col("t").alias(f"t{c}"), F.col("path").alias(c))
    both = pairs.join(side("a"), "ta").join(side("b"), "tb").select("a", "b")
    both = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)).sortWithinPartitions("a", "b")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # pairs of tiles
    try:
        found = materialise(both.mapInArrow(_compare(axes, threshold, dim, "f8" if kind == "double" else "f4"), "vec long, other long, links long"), "found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    counts = found.where("other IS NULL").groupBy("vec").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("vec").alias("a"), F.col("other").alias("b")))
    nodes = classes.join(counts.withColumnRenamed("vec", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = materialise(nodes.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp")), "nodes")
    # rows that link with nothing stay out of the join: they may be many with one value
    out = rows.where("good").join(nodes, "embedding").select("vec_id", "n_links", "comp")
    out = out.unionByName(rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("comp")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("comp"), F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings against all, cosine >= 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


#: All pairs by cosine, and the smallest vec_id that links reach. Equal rows of one vec_id do not occur in the tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), links AS (SELECT a, count(*) AS n FROM link GROUP BY a
), lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN lowest ON lowest.a = vec_id
"""
