"""Sums of potentials of many points in linear time, by expansions on an octree.

`Engine.build` makes the tree and its lists once; `evaluate` takes strengths keyed by
source and returns results by target. The kernel (`operators.kernels`) has the
mathematics; here is what moves where:

- Multipoles of ALL boxes at once: a leaf's multipole is carried up its chain of
  parents inside the task that made it, partial sums are merged by box. The
  translation is exact, so no loop over levels is needed.
- M2L by families: a parent's children's multipoles are one row, sent to the
  parent's 26 neighbours; the far pairs of the families of an Arrow batch are grouped
  by offset, one matrix product each. So a multipole is moved 27/8 times, not 189.
- Locals move down level by level, each to its children.
- Near points likewise go to families of leaves: a leaf's points are sent to a parent
  once, with the list of its children that need them.
- Coincident points are one: strengths of sources are added up, targets share a result. The
  tree's cap counts places, so the near work of a leaf does not grow with the copies of a place.
- Points of a leaf are packed in rows of at most about PACK points, and the packs of a
  crowded leaf go to tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morton as mk
from ..functions.harmonics import far_offsets
from ..operators.kernels import POINTS, Helmholtz, Kernel, Laplace, Yukawa, degree_for
from ..work import dealt, saved
from . import near, tree

PACK = 512
#: Place of each far offset (7 x 7 x 7 cells around 0) among the far matrices; -1: near.
_PLACE = np.full((7, 7, 7), -1)
_PLACE[tuple((far_offsets() + 3).T)] = np.arange(316)


def _index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level, and index (.., 3) on the own level."""
    lev = (keys & mk.LEVEL_MASK).astype(np.int64)
    digits = keys >> mk.LEVEL_BITS
    out = np.zeros((*keys.shape, 3), np.int64)
    for bit in range(mk.DEPTH):
        for a in range(3):
            out[..., a] |= (digits >> (3 * bit + 2 - a) & 1) << bit
    return lev, out >> (mk.DEPTH - lev)[..., None]


def _centres(keys: np.ndarray, domain) -> np.ndarray:
    lev, ijk = _index(keys)
    return np.array(domain[:3]) + (2 * ijk + 1) * (domain[3] / 2.0 ** (lev + 1))[..., None]


def _parents(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents and octants of keys other than the root."""
    at = mk.LEVEL_BITS + 3 * (mk.DEPTH - (keys & mk.LEVEL_MASK))
    return (keys & ~(7 << at)) - 1, keys >> at & 7


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _rows(keys, values) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys, pa.int64()), pa.array(list(values), pa.list_(pa.float64()))], names=["key", "c"])


class Engine:
    """Settings: kernel, max_points_per_leaf, max_level, min_level, domain (a cube: corner and three equal sides), near.

    near is a rule of `near`: W and X pairs between leaves that it holds for are summed directly.
    """

    def __init__(self, kernel: Kernel, max_points_per_leaf: int = 64, max_level: int = mk.DEPTH, min_level: int = 0, domain: tuple[float, ...] | None = None, near=None):
        if not 0 <= max_level <= mk.DEPTH or max_points_per_leaf < 1:
            raise ValueError("max_level must be 0..16, max_points_per_leaf at least 1")
        self.kernel, self.cap, self.max_level, self.min_level, self.domain, self.near = kernel, max_points_per_leaf, max_level, min_level, domain, near

    def build(self, sources: DataFrame, targets: DataFrame) -> "Engine":
        """sources(source_id, x, y, z) and targets(point_id, x, y, z): makes domain, tree and lists.

        One tree holds both. Null coordinates are an error, as are points outside a given domain.
        """
        s, t = sources.select("source_id", "x", "y", "z"), targets.select("point_id", "x", "y", "z")
        same = sources is targets  # points that are both are read once
        own = tree.domain_of(s) if same else tree.domain_of(s, t)
        if self.domain is None:
            self.domain = own
        else:
            tree.check_domain(self.domain, own)
        self.kernel.side = self.domain[3]
        s, t = tree.keyed(s, self.domain), tree.keyed(t, self.domain)
        keys = saved((s.select("key16") if same else s.select("key16").union(t.select("key16"))).distinct(), "keys")
        self.boxes = saved(tree.balanced(tree.levels(keys, self.cap, self.max_level, self.min_level)), "boxes")
        levels = tree.leaf_levels(self.boxes)
        self.depth = levels[1]
        lists = tree.lists(self.boxes)  # V lists, most of the pairs, are not needed by evaluate: left to whoever asks for them
        self.lists = saved(lists.where("kind <> 'V'"), "lists").unionByName(lists.where("kind = 'V'"))
        self.sources = saved(tree.leaf_of(s, self.boxes, levels=levels).drop("key16"), "sources")
        self.targets = saved(tree.leaf_of(t, self.boxes, levels=levels).drop("key16"), "targets")
        # a place's own number: point_ids may repeat or be null
        places = self.targets.groupBy("leaf", "x", "y", "z").agg(F.count("*").alias("n")).withColumn("place", F.monotonically_increasing_id())
        places = saved(places, "places")
        self.places, self.copies = self.targets, None
        if places.where("n > 1").limit(1).count():
            self.places = places.select(F.col("place").alias("point_id"), "leaf", "x", "y", "z")
            self.copies = saved(self.targets.join(places, ["leaf", "x", "y", "z"]).select("point_id", "place"), "copies")
        if self.near is not None:
            self.lists = saved(near.converted(self.lists, self.counts(), self.near), "lists")
        return self

    def counts(self) -> DataFrame:
        """Sources and targets of every box."""
        return near.box_counts(self.boxes, self.sources, self.targets)

    def work(self, unit: str = "pairs") -> DataFrame:
        """The work on each box by kind."""
        return near.work(self.lists, self.counts(), unit)

    def list_sizes(self) -> DataFrame:
        """Pairs of each interaction list."""
        return self.lists.groupBy("kind").agg(F.count("*").alias("pairs"))

    def exchanged(self) -> DataFrame:
        """How many boxes' expansions (V, W) and points (U, X) cross from one box to another, by list."""
        n = self.sources.groupBy("leaf").agg(F.count("*").alias("n"))
        near = self.lists.where("kind IN ('U', 'X')").join(n, F.col("source") == F.col("leaf")).groupBy("kind").agg(F.countDistinct("source").alias("boxes"), F.sum("n").alias("moved"))
        return near.unionByName(self.lists.where("kind IN ('V', 'W')").groupBy("kind").agg(F.countDistinct("source").alias("boxes"), F.count("*").alias("moved")))

    def _packed(self, points: DataFrame, key: str, columns: list) -> DataFrame:
        """leaf, chunk, ids (longs), values (doubles by row): at most about PACK points a row."""
        n = points.groupBy("leaf").agg(F.ceil(F.count("*") / PACK).cast("int").alias("parts"))
        p = points.join(n, "leaf").select("leaf", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("chunk"), F.struct(F.col(key).alias("id"), F.array(*columns).alias("v")).alias("row"))
        return p.groupBy("leaf", "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("leaf", "chunk", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("values"))

    def _sources_with(self, strengths: DataFrame) -> DataFrame:
        cols = self.kernel.parameters
        given = strengths.select("source_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in strengths.columns else F.lit(0.0).alias(c) for c in cols])
        if given.groupBy("source_id").count().where("count > 1").limit(1).count():
            raise ValueError("a source has two strengths")
        s = self.sources.join(given, "source_id", "left").groupBy("leaf", "x", "y", "z").agg(F.min("source_id").alias("source_id"), *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in cols])
        return self._packed(s, "source_id", ["x", "y", "z", *cols])

    def multipoles(self, packed: DataFrame) -> DataFrame:
        """key, c: the multipoles (vectors x size, flat) of all boxes with sources, from their packed points and strengths."""
        kernel, domain = self.kernel, self.domain
        m, size = kernel.vectors, kernel.size

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column("leaf").to_numpy()
                made, total = _expanded(kernel, "M", domain, keys, b.column("values")), {}  # level: keys and their sums
                for lev in range(mk.DEPTH, -1, -1):
                    own = keys & mk.LEVEL_MASK == lev
                    at, c = keys[own], made[own]
                    if lev + 1 in total:
                        low, lc = total[lev + 1]
                        up, octant = _parents(low)
                        moved = np.empty_like(lc)
                        for o in range(8):
                            if (octant == o).any():
                                moved[octant == o] = kernel.move(lc[octant == o], kernel.up(lev + 1)[o])
                        at, c = np.concatenate([at, up]), np.concatenate([c, moved])
                    if len(at):
                        keys_, inverse = np.unique(at, return_inverse=True)
                        sums = np.zeros((len(keys_), m, size))
                        np.add.at(sums, inverse, c)
                        total[lev] = keys_, sums
                for keys_, sums in total.values():
                    yield _rows(keys_, sums.reshape(len(keys_), -1))

        # near leaves share parents, so a task has few boxes besides its leaves; as many tasks as shuffles have, for the bytes are few
        rows = packed.select("leaf", "values").repartitionByRange(_tasks(packed), "leaf")
        return _merged(rows.mapInArrow(run, "key long, c array<double>"), m * size)

    def locals_(self, poles: DataFrame, packed: DataFrame) -> DataFrame:
        """key, c: the locals of all boxes of level 2 and below, their ancestors' included, that are above targets."""
        kernel, m, size = self.kernel, self.kernel.vectors, self.kernel.size
        wanted = saved(self.targets.select("leaf").distinct().select(F.explode(mk.ancestors(F.col("leaf"))).alias("key")).distinct(), "wanted")
        own = saved(self._far(poles, packed, wanted), "far")
        levels = [saved(own.where(mk.level("key") == 2), "locals")] if self.depth >= 2 else []

        def run(batches):
            for b in batches:
                keys, c = b.column("key").to_numpy(), _flat(b.column("c")).reshape(-1, m, size)
                octant = _parents(keys)[1]
                for o in range(8):
                    at = np.flatnonzero(octant == o)
                    if len(at):
                        moved = kernel.move(c[at], kernel.down(int(keys[at[0]]) & mk.LEVEL_MASK)[o])
                        yield _rows(keys[at], moved.reshape(len(at), -1))

        for lev in range(3, self.depth + 1):
            children = wanted.where(mk.level("key") == lev).select("key", mk.parent("key").alias("up"))
            moved = children.join(levels[-1].withColumnRenamed("key", "up"), "up").select("key", "c").mapInArrow(run, "key long, c array<double>")
            levels.append(saved(_merged(moved.unionByName(own.where(mk.level("key") == lev)), m * size), "locals"))
        out = own.where("false")
        for x in levels:
            out = out.unionByName(x)
        return out

    def evaluate(self, strengths: DataFrame) -> DataFrame:
        """Results of all targets: point_id and the kernel's outputs.

        strengths: source_id and the kernel's parameters (a column that is absent counts as
        0, as do nulls and sources without strengths; a repeated source_id is an error).
        """
        kernel, domain = self.kernel, self.domain
        width, m, size = 3 + len(kernel.parameters), kernel.vectors, kernel.size
        packed = saved(self._sources_with(strengths), "packed")
        tpacked = saved(self._packed(self.places, "point_id", [F.col(c) for c in "xyz"]), "targets")
        poles = saved(self.multipoles(packed), "multipoles")
        local = self.locals_(poles, packed)
        family = lambda c: F.coalesce(mk.parent(c), F.lit(0).cast("long"))
        # per family of leaves and number of their chunks: targets (A), locals (L), multipoles of W (M), points of U and themselves (P)
        own = tpacked.select(family("leaf").alias("to"), "chunk", F.lit("A").alias("kind"), F.col("leaf").alias("key"), F.array("leaf").alias("on"), F.col("values").alias("c"), "ids")
        blocks = own.select("to", "chunk").distinct()
        need = self.lists.where("kind IN ('U', 'W')").select("kind", "target", "source").unionByName(self.boxes.where("is_leaf").select(F.lit("U").alias("kind"), F.col("key").alias("target"), F.col("key").alias("source")))
        need = need.join(self.targets.select(F.col("leaf").alias("target")).distinct(), "target", "left_semi")
        need = need.groupBy(family("target").alias("to"), "kind", F.col("source").alias("key")).agg(F.sort_array(F.collect_list("target")).alias("on"))  # at most 8
        u = need.where("kind = 'U'").join(packed.select(F.col("leaf").alias("key"), F.col("values").alias("c")), "key").withColumn("kind", F.lit("P"))
        w = need.where("kind = 'W'").join(poles, "key").withColumn("kind", F.lit("M"))
        down = local.join(tpacked.select(F.col("leaf").alias("key")).distinct(), "key", "left_semi").select(family("key").alias("to"), F.lit("L").alias("kind"), "key", F.array("key").alias("on"), "c")
        names = ["to", "kind", "key", "on", "c"]
        more = u.select(names).unionByName(w.select(names)).unionByName(down.select(names)).join(blocks, "to").withColumn("ids", F.lit(None).cast("array<long>"))
        columns = ["to", "chunk", "kind", "key", "on", "c", "ids"]
        rows = dealt(own.select(columns).unionByName(more.select(columns)), "to", "chunk").sortWithinPartitions("to", "chunk", "kind", "key", F.size("c"))

        def run(batches):
            blocks, at = [], None  # blocks of targets, the last one open: leaf, ids, x, sums
            held, points = {"L": [], "M": []}, 0  # expansions to be evaluated, with the targets; many at once

            def settle():
                for kind, some in held.items():
                    if not some:
                        continue
                    keys, n = np.array([e[0] for e in some]), np.array([len(e[1]) for e in some])
                    x = np.concatenate([e[1] for e in some]) - np.repeat(_centres(keys, domain), n, axis=0)
                    got = kernel.evaluations(kind, keys & mk.LEVEL_MASK, x, np.stack([e[2] for e in some]), np.cumsum(n) - n)
                    for (_, _, _, chosen), part in zip(some, np.split(got, np.cumsum(n)[:-1]), strict=True):
                        add(chosen, part)
                    some.clear()

            def add(chosen, got):
                lo = 0
                for t in chosen:
                    t[3] = t[3] + got[lo : lo + len(t[2])]
                    lo += len(t[2])

            def finished(some):
                for block in some:
                    for _, ids, _, out in block:
                        yield pa.record_batch([pa.array(ids, pa.int64()), *map(pa.array, kernel.result(out))], names=["point_id", *kernel.outputs])

            for b in batches:
                cols = [b.column(n) for n in columns]
                ends = {"c": cols[5].offsets.to_numpy(), "on": cols[4].offsets.to_numpy()}
                flat, leaves = cols[5].values.to_numpy(), cols[4].values.to_numpy()
                for i, (to, chunk, kind, key) in enumerate(zip(*(c.to_pylist() for c in cols[:4]), strict=True)):
                    c = flat[ends["c"][i] : ends["c"][i + 1]]
                    if at != (to, chunk):
                        if points >= POINTS:
                            settle()
                            yield from finished(blocks)
                            blocks, points = [], 0
                        blocks.append([])
                        at = (to, chunk)
                    block = blocks[-1]
                    if kind == "A":
                        x = c.reshape(-1, 3)
                        block.append([key, cols[6][i].values.to_numpy(), x, 0])
                        points += len(x)
                        continue
                    on = set(leaves[ends["on"][i] : ends["on"][i + 1]].tolist())
                    chosen = [t for t in block if t[0] in on]
                    if not chosen:
                        continue
                    x = np.concatenate([t[2] for t in chosen])
                    if kind == "P":
                        pts = c.reshape(-1, width)
                        add(chosen, kernel.near(x, pts[:, :3], pts[:, 3:]))
                        continue
                    held[kind].append((key, x, c.reshape(m, size), chosen))
                    points += len(x)
                    if points >= 4 * POINTS:  # a block of many expansions
                        settle()
                        points = 0 if len(blocks) == 1 else POINTS
            settle()
            yield from finished(blocks)

        got = rows.mapInArrow(run, ", ".join(["point_id long", *[f"{n} double" for n in kernel.outputs]]))
        if self.copies is None:
            return got
        return self.copies.join(got.withColumnRenamed("point_id", "place"), "place").select("point_id", *kernel.outputs)

    def _far(self, poles: DataFrame, packed: DataFrame, wanted: DataFrame) -> DataFrame:
        """key, c: what V and X lists give each wanted box itself (not its ancestors')."""
        kernel, domain = self.kernel, self.domain
        m, size = kernel.vectors, kernel.size
        deep = poles.where(mk.level("key") >= 2).select(mk.parent("key").alias("family"), "key", "c")
        family = deep.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("key", "c"))).alias("kids"))  # at most 8
        sent = family.select(F.explode(mk.neighbours("family")).alias("to"), F.col("family").alias("of"), "kids")
        mine = wanted.where(mk.level("key") >= 2).select(mk.parent("key").alias("to"), "key").groupBy("to").agg(F.sort_array(F.collect_list("key")).alias("own"))
        both = dealt(sent.join(mine, "to"), "to").sortWithinPartitions(mk.level("to"), "to", "of")

        def far(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                own, kids = b.column("own"), b.column("kids")
                n_own, n_kids = (np.diff(c.offsets.to_numpy()) for c in (own, kids))
                targets, sources = own.flatten().to_numpy(), kids.flatten().field("key").to_numpy()
                c = _flat(kids.flatten().field("c")).reshape(-1, m, size)
                # all pairs (target, source) of each row
                row = np.repeat(np.arange(len(own)), n_own * n_kids)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n_own * n_kids) - n_own * n_kids, n_own * n_kids)
                t = np.repeat(np.cumsum(n_own) - n_own, n_own * n_kids) + place // n_kids[row]
                s = np.repeat(np.cumsum(n_kids) - n_kids, n_own * n_kids) + place % n_kids[row]
                lev, ijk = _index(targets)
                apart = _PLACE[tuple((ijk[t] - _index(sources)[1][s] + 3).T)]
                on = apart >= 0
                t, s, apart = t[on], s[on], apart[on]
                keys, into = np.unique(targets, return_inverse=True)
                total = np.zeros((len(keys), m, size))
                order = np.lexsort((apart, lev[t])) if kernel.by_level else np.argsort(apart, kind="stable")
                t, s, apart = t[order], s[order], apart[order]
                group = lev[t] * 316 + apart if kernel.by_level else apart
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(group)), strict=True):  # a target has one source at an offset
                    total[into[t[lo:hi]]] += kernel.move(c[s[lo:hi]], kernel.far(int(lev[t[lo]]))[apart[lo]])
                yield _rows(keys, total.reshape(len(keys), -1))

        v = both.select("own", "kids").mapInArrow(far, "key long, c array<double>")
        x = self.lists.where("kind = 'X'").join(wanted.withColumnRenamed("key", "target"), "target").join(packed.select(F.col("leaf").alias("source"), "values"), "source")

        def close(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    keys = part.column("target").to_numpy()
                    begin = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
                    yield _rows(keys[begin], np.add.reduceat(_expanded(kernel, "L", domain, keys, part.column("values")), begin, axis=0).reshape(len(begin), -1))

        x = dealt(x.select("target", "values"), "target").sortWithinPartitions("target", "values")
        return _merged(v.unionByName(x.mapInArrow(close, "key long, c array<double>")), m * size)


def LaplaceEngine(p: int | None = None, tolerance: float = 1e-3, gradients: bool = False, vectors: int = 1, dipole: bool = False, strategy: str = "auto", **tree_settings) -> Engine:
    """An engine for charges q (q0, q1, ... for several vectors) and with dipole moments mx, my, mz."""
    return Engine(Laplace(degree_for(tolerance) if p is None else p, vectors, gradients, dipole, strategy), **tree_settings)


def HelmholtzEngine(k: complex, p: int | None = None, tolerance: float = 1e-3, gradients: bool = False, vectors: int = 1, strategy: str = "auto", **tree_settings) -> Engine:
    """An engine for complex charges q_re, q_im and the wave number k."""
    return Engine(Helmholtz(k, p, tolerance, vectors, gradients, strategy), **tree_settings)


def YukawaEngine(kappa: float, p: int | None = None, tolerance: float = 1e-3, gradients: bool = False, vectors: int = 1, strategy: str = "auto", **tree_settings) -> Engine:
    """An engine for real charges q screened with kappa."""
    return Engine(Yukawa(kappa, p, tolerance, vectors, gradients, strategy), **tree_settings)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _expanded(kernel: Kernel, kind: str, domain, keys: np.ndarray, values: pa.Array) -> np.ndarray:
    """Expansions (rows, vectors, size) about the boxes keys of the points and strengths of each row (one point at least)."""
    width = 3 + len(kernel.parameters)
    n = np.diff(values.offsets.to_numpy()) // width
    pts = _flat(values).reshape(-1, width)
    return kernel.expansions(kind, keys & mk.LEVEL_MASK, pts[:, :3] - np.repeat(_centres(keys, domain), n, axis=0), pts[:, 3:], np.cumsum(n) - n)


def _merged(parts: DataFrame, size: int) -> DataFrame:
    """Sums of the arrays of a key: parts in the order of their values, so the result doesn't depend on arrival."""
    rows = dealt(parts, "key").sortWithinPartitions("key", "c")

    def run(batches):
        last = None  # the key that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            keys, c = b.column("key").to_numpy(), _flat(b.column("c")).reshape(-1, size)
            begin = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            sums, found = np.add.reduceat(c, begin, axis=0), keys[begin]
            if last is not None:
                if last[0] == found[0]:
                    sums[0] += last[1]
                else:
                    yield _rows([last[0]], [last[1]])
            last = found[-1], sums[-1]
            if len(found) > 1:
                yield _rows(found[:-1], sums[:-1])
        if last is not None:
            yield _rows([last[0]], [last[1]])

    return rows.mapInArrow(run, "key long, c array<double>")
