"""N-gram Jaccard self-join by parity sketches.

A document's distinct word shingles are XORed into a bit sketch, one bit a
shingle, so the Hamming distance of two sketches is at most the symmetric
difference d of their sets. Jaccard >= num/den means
d <= (a + b)(den - num)/(den + num) for sets of a and b shingles.

Sizes fall into bands whose bounds grow by den/num, so that the partners of a
set lie in its own band or a neighbouring one; each pair of neighbouring bands
is a group with one largest difference D. There the (very long, sparse) sketch
is cut into more than D segments, of which one at least must be equal in both
(pigeonhole). A segment is keyed by the XOR of its bits' 64-bit codes. Segments
that hold few shingles are shared by chance, so a set leaves out those of fewer
than 3 (then 2, then 1) shingles as long as more than D segments remain; this
loses no pair: of the set that keeps the larger ones, one kept segment is
untouched and thus kept by the other set as well. Candidates pass a short folded
sketch's Hamming bound, then the exact sets decide.

Equal sets are one node from the start, whatever the number of copies. The buckets
that share a centre (their member of least hash) are one canopy, whose members are
kept once: near copies meet in a few canopies, not in each of their many segments.
All members are compared with the centre, then those that are still apart with
STARS - 1 other members; each of these rounds makes a pair a row. What is left of a
canopy is compared in blocks of bounded rows and shingles, exactly and within the
task, from which only a spanning forest of the links leaves.

This finds a spanning set of links. All links lie within components, so their number
is counted there, by comparing all sets of each component with each other exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import components, materialise, maybe_broadcast, small_batches

#: Sets that are compared together, and bits of the sketches looked at before the sets are.
BLOCK, SHORT = 2000, 2048
#: Rounds in which each member of a canopy is compared with one of them.
STARS = 3
#: Blocks have so many shingles at most; the links of a component of SPREAD sets and more are counted by several tasks.
BLOCK_SHINGLES, SPREAD = 4_000_000, 256
#: Keys that are frequent in a sample (one set of HOT_PART, HOT_SEEN times; the HOT_KEYS most frequent) are dealt to
#: HOT_PARTS tasks each. This changes where rows go, never a result.
HOT_PART, HOT_SEEN, HOT_KEYS, HOT_PARTS = 64, 16, 100_000, 64


def bands(num: int, den: int, upto: int) -> np.ndarray:
    """Lower bounds of the size bands, from 1 to beyond upto."""
    low = [1]
    while low[-1] <= upto:
        low.append(low[-1] * den // num + 1)
    return np.array([*low, low[-1] * den // num + 1, (low[-1] * den // num + 1) * den // num + 1], np.int64)


def _sets(batch: pa.RecordBatch, k: int):
    buf, at = tb.utf8(batch.column("text"))
    words, where, _ = tb.word_hashes(tb.LOWER[buf], at, tb.SPACE)
    for i in range(batch.num_rows):
        yield tb.shingle_hashes(words[where[i] : where[i + 1]], k)


def sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles on 2^j >= 2n bits."""
    bits = max(6, int(2 * len(h) - 1).bit_length()) if len(h) else 6
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two parity sketches, the longer one folded: neighbouring bits are XORed, which keeps the bound."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    while len(x) > len(y):
        x = x[::2] ^ x[1::2]
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return int(np.count_nonzero(x != y))


def segment_keys(h: np.ndarray, num: int, den: int, low: np.ndarray) -> np.ndarray:
    """The keys under which a set is looked up, in both groups of its band."""
    n = len(h)
    band = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for g in (band - 1, band):
        if g < 0:
            continue
        d = int(2 * (low[g + 2] - 1) * (den - num) // (den + num))
        cut = 1 if d == 0 else d + d // 4 + 1
        seg = ((h >> np.uint64(32)) * np.uint64(cut)) >> np.uint64(32)
        seg = seg.astype(np.int64)
        count = np.bincount(seg, minlength=cut)
        order = np.argsort(seg, kind="stable")
        full = np.flatnonzero(count)
        value = np.zeros(cut, np.uint64)
        value[full] = np.bitwise_xor.reduceat(tb.mix(h)[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]))
        least = next(c for c in (3, 2, 1, 0) if np.count_nonzero(count >= c) > d)
        keep = np.flatnonzero(count >= least)
        out.append(tb.mix(value[keep] ^ tb.mix(np.uint64(g << 40) + keep.astype(np.uint64) + np.uint64(1))))
    return np.concatenate(out)


def _sums(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two sums of each set's hashes, which tell classes of equal sets apart."""
    return [int(np.add.reduce(h, dtype=np.uint64).astype(np.int64)) for h in sets], [int(np.add.reduce(tb.mix(h + np.uint64(9)), dtype=np.uint64).astype(np.int64)) for h in sets]


def _profile(k: int):
    def run(batches):
        for b in batches:
            n, h1, h2, sk = [], [], [], []
            for h in _sets(b, k):
                n.append(len(h))
                for into, x in zip((h1, h2), _sums([h]), strict=True):
                    into.append(x[0])
                sk.append(sketch(h))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "n", "h1", "h2", "sk"])

    return run


def _emit(k: int, num: int, den: int, most: int):
    low = bands(num, den, most)

    def run(batches):
        for b in batches:
            ids, keys, ns = [], [], []
            for i, h in zip(b.column("doc_id").to_pylist(), _sets(b, k), strict=True):
                if len(h):
                    x = segment_keys(h, num, den, low)
                    keys.append(x)
                    ids.append(np.full(len(x), i, np.int64))
                    ns.append(np.full(len(x), len(h), np.int32))
            for x, i, n in zip(keys, ids, ns, strict=True):
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(i), pa.array(n)], names=["key", "doc_id", "n"])

    def joined(batches):  # a few large batches instead of one a document
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


def _set_rows(k: int):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([h.tobytes() for h in _sets(b, k)], pa.binary())], names=["doc_id", "hs"])

    return run


def _near(num: int, den: int):
    """Keeps the pairs whose sketches allow the threshold."""

    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
            ok = [(den + num) * hamming(x, y) <= (p + q) * (den - num) for x, y, p, q in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), na, nb, strict=True)]
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _exact(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _short(sk: bytes, bits: int) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(sk, np.uint8))
    while len(x) > bits:
        x = x[::2] ^ x[1::2]
    return np.packbits(x)


def _folded(batches):
    """Sketches of at most SHORT bits."""
    for b in batches:
        yield pa.record_batch([b.column("doc_id"), pa.array([_short(s, SHORT).tobytes() for s in b.column("sk").to_pylist()], pa.binary())], names=["doc_id", "f"])


def _blocks(batches, names: tuple[str, ...]):
    """Rows sorted by (centre, kind, lo, hi), a block at a time, as tuples of the columns after these four."""
    held, at = [], None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("centre", "kind", "lo", "hi", *names)), strict=True):
            if at != row[:4]:
                if len(held) > 1:
                    yield at, held
                held, at = [], row[:4]
            held.append(row[4:])
    if len(held) > 1:
        yield at, held


def _sides(at, side: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that are compared, and those that they are compared with."""
    if at[1] == "A":
        return np.flatnonzero(~main), np.arange(len(side))
    if at[1] == "M":  # open rows of side lo with rows of the centre's component of side hi
        return np.flatnonzero(~main), np.flatnonzero(main)
    return np.flatnonzero(side == at[2]), np.flatnonzero(side == at[3])


def _alike(num: int, den: int):
    """Of blocks, the rows with a partner of another component that sizes and short sketches allow."""

    def run(batches):
        for at, rows in _blocks(batches, ("doc_id", "n", "comp", "main", "side", "f")):
            ids, n, comp, main, side = (np.array([r[i] for r in rows]) for i in range(5))
            width = min(len(r[5]) for r in rows) * 8
            f = np.stack([_short(r[5], width) for r in rows])
            left, right = _sides(at, side, main)
            found = np.zeros(len(rows), bool)
            for i in left:
                j = right[(comp[right] != comp[i]) & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))]
                if len(j):
                    j = j[(den + num) * np.bitwise_count(f[j] ^ f[i]).sum(axis=1, dtype=np.int64) <= (n[j] + n[i]) * (den - num)]
                    if len(j):
                        found[i] = True
                        found[j] = True
            if found.any():
                yield pa.record_batch([pa.array(np.full(int(found.sum()), at[0])), pa.array(ids[found])], names=["centre", "doc_id"])

    return run


def _coded(sets: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sets' shingles as small numbers, one set after the other, and where each begins."""
    code = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_inverse=True)[1].astype(np.int32)
    return code, np.concatenate([[0], np.cumsum(n)])


def _forest(num: int, den: int):
    """Of blocks, links that connect what is connected by links of the block and by the components so far."""

    def run(batches):
        for at, rows in _blocks(batches, ("doc_id", "n", "comp", "main", "side", "hs")):
            rows.sort(key=lambda r: (r[1], r[0]))
            ids, n, comp, main, side = (np.array([r[i] for r in rows]) for i in range(5))
            root = np.unique(comp, return_inverse=True)[1]
            left, right = _sides(at, side, main)
            code, begin = _coded([r[5] for r in rows], n)
            there = np.concatenate([code[begin[j] : begin[j + 1]] for j in right]) if len(right) else code[:0]
            start = np.concatenate([[0], np.cumsum(n[right])])
            mark, a, b = np.zeros(int(code.max()) + 1, bool), [], []
            for i in left:
                lo, hi = np.searchsorted(n[right], -(-num * n[i] // den), "left"), np.searchsorted(n[right], den * n[i] // num, "right")
                if lo >= hi or (root[right[lo:hi]] == root[i]).all():
                    continue
                own = code[begin[i] : begin[i + 1]]
                mark[own] = True
                both = np.add.reduceat(mark[there[start[lo] : start[hi]]], start[lo:hi] - start[lo], dtype=np.int64)
                mark[own] = False
                j = right[lo:hi]
                j = j[(den * both >= num * (n[i] + n[j] - both)) & (root[j] != root[i])]
                if len(j):
                    j = j[np.unique(root[j], return_index=True)[1]]  # one link to each component
                    a.append(np.full(len(j), ids[i]))
                    b.append(ids[j])
                    root[np.isin(root, root[j])] = root[i]
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _canopies(reps: DataFrame, k: int, num: int, den: int, most: int) -> DataFrame:
    """centre, cn, doc_id, n: the members of all buckets that hold several sets, once for each centre; n, cn: sizes."""
    emit = _emit(k, num, den, most)
    part = reps.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HOT_PART)) == 0).mapInArrow(emit, "key long, doc_id long, n int")
    hot = materialise(part.groupBy("key").count().where(F.col("count") >= HOT_SEEN).orderBy(F.desc("count"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot")), "hot")
    keys = reps.mapInArrow(emit, "key long, doc_id long, n int").join(F.broadcast(hot), "key", "left")
    keys = keys.select("key", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(HOT_PARTS)).cast("int")).alias("part"), "doc_id", "n")
    bucket = Window.partitionBy("key", "part")
    least = F.min(F.struct(F.xxhash64("doc_id").alias("o"), "doc_id", "n"))
    met = keys.withColumn("c", F.count("*").over(bucket)).withColumn("m", least.over(bucket)).where("c > 1 OR part IS NOT NULL")
    met = materialise(met.select("key", "part", "doc_id", "n", "m"), "buckets")
    tops = met.where("part IS NOT NULL").groupBy("key").agg(F.min("m").alias("top"))  # a row a hot key
    met = met.join(F.broadcast(tops), "key", "left").withColumn("m", F.coalesce("top", "m"))
    return materialise(met.select(F.col("m.doc_id").alias("centre"), F.col("m.n").alias("cn"), "doc_id", "n").distinct(), "canopies")


def _in_blocks(live: DataFrame) -> DataFrame:
    """live(centre, doc_id, n, comp, main, ...) with kind, lo, hi, side, by block.

    A canopy within the bounds is one block (kind A). Else open rows meet each other
    (U) and the rows of the centre's component (M), which don't meet among themselves.
    """
    by = live.groupBy("centre").agg(*[f(F.when(F.col("main") == m, x)).alias(f"{a}{int(m)}") for m in (True, False) for a, f, x in (("m", F.count, F.lit(1)), ("w", F.sum, F.col("n").cast("long")))])
    parts = lambda m: F.greatest(F.ceil(F.col(f"m{m}") / BLOCK), F.ceil(F.coalesce(f"w{m}", F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    one = (F.col("m0") + F.col("m1") <= BLOCK) & (F.coalesce("w0", F.lit(0)) + F.coalesce("w1", F.lit(0)) <= BLOCK_SHINGLES)
    by = by.select("centre", one.alias("one"), parts(1).alias("mains"), parts(0).alias("opens")).where("opens > 0")
    rows = live.join(by, "centre").withColumn("side", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("opens"))).cast("int"))
    place = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<kind:string,lo:int,hi:int>>")
    with_main = F.when(F.col("mains") > 0, F.transform(upto("mains"), lambda o: place("M", F.col("side"), o))).otherwise(none)
    with_open = F.transform(upto("opens"), lambda o: place("U", F.least("side", o), F.greatest("side", o)))
    to = F.when(F.col("one"), F.array(place("A", F.lit(0), F.lit(0)))).when(F.col("main"), F.transform(upto("opens"), lambda o: place("M", o, F.col("side")))).otherwise(F.concat(with_main, with_open))
    rows = rows.withColumn("to", F.explode(to)).drop("one", "mains", "opens")
    return rows.select("centre", "to.kind", "to.lo", "to.hi", *[c for c in rows.columns if c not in ("centre", "to")])


def _dealt(rows: DataFrame, *names: str) -> DataFrame:
    at = ("centre", "kind", "lo", "hi")
    return rows.select(*at, *names).repartition(*at).sortWithinPartitions(*at)


def _labelled(canopies: DataFrame, labels: DataFrame | None, *more) -> DataFrame:
    """Canopies of several components, with comp, main (of the centre's component), and aggregates of the canopy."""
    if labels is None:
        live = canopies.withColumn("comp", F.col("doc_id")).withColumn("top", F.col("centre"))
    else:
        live = canopies.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(labels.select(F.col("node").alias("centre"), F.col("comp").alias("top")), "centre", "left")
        live = live.withColumn("comp", F.coalesce("comp", "doc_id")).withColumn("top", F.coalesce("top", "centre"))
    live = live.withColumn("main", F.col("comp") == F.col("top")).select("centre", "cn", "doc_id", "n", "comp", "main")
    by = live.groupBy("centre").agg(F.min("main").alias("same"), *more).where("NOT same").drop("same")
    return live.join(by, "centre")


def _class_sets(batches):
    """Sets with what their classes are told by."""
    for b in batches:
        hs = [np.frombuffer(x, np.uint64) for x in b.column("hs").to_pylist()]
        h1, h2 = _sums(hs)
        yield pa.record_batch([b.column("doc_id"), pa.array([len(h) for h in hs], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), b.column("hs")], names=["doc_id", "n", "h1", "h2", "hs"])


def _link_counts(num: int, den: int):
    """From rows sorted by (comp, lo, hi): how many copies of other sets each set links with, exactly."""

    def counts(rows):
        rows = sorted(rows, key=lambda r: r[6])
        lo, hi = rows[0][1:3]
        side, n, copies = (np.array([r[i] for r in rows], np.int64) for i in (3, 6, 7))
        code, at = _coded([r[8] for r in rows], n)
        left = np.flatnonzero(side == lo)
        right = left if lo == hi else np.flatnonzero(side == hi)
        there = np.concatenate([code[at[j] : at[j + 1]] for j in right]) if len(right) else code[:0]
        begin = np.concatenate([[0], np.cumsum(n[right])])
        mark, out = np.zeros(int(code.max()) + 1, bool), np.zeros(len(rows), np.int64)
        for i in left:
            a, z = np.searchsorted(n[right], -(-num * n[i] // den), "left"), np.searchsorted(n[right], den * n[i] // num, "right")
            if a >= z:
                continue
            own = code[at[i] : at[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[there[begin[a] : begin[z]]], begin[a:z] - begin[a], dtype=np.int64)
            mark[own] = False
            j = right[a:z]
            j = j[(den * both >= num * (n[i] + n[j] - both)) & (j != i)]
            out[i] += copies[j].sum()
            if lo != hi:
                out[j] += copies[i]
        found = np.flatnonzero(out)
        return pa.record_batch([pa.array([rows[i][c] for i in found], pa.int64()) for c in (4, 5, 6)] + [pa.array(out[found])], names=["h1", "h2", "n", "links"])

    def run(batches):
        held = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("comp", "lo", "hi", "side", "h1", "h2", "n", "copies", "hs")), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield counts(held)
                    held = []
                held.append(row)
        if held:
            yield counts(held)

    return run


def _count_links(sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """h1, h2, n, links of the classes(h1, h2, n, rep, copies, comp) that link with others; sets(doc_id, hs) holds their representatives."""
    sizes = classes.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
    nb = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES), F.least(F.lit(8), F.ceil(F.col("m") / SPREAD)))
    classes = classes.join(sizes.select("comp", nb.cast("int").alias("nb")), "comp")
    rows = sets.mapInArrow(_class_sets, "doc_id long, n long, h1 long, h2 long, hs binary").join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "n", "doc_id"]).dropDuplicates(["h1", "h2", "n"])
    rows = rows.withColumn("side", F.pmod(F.xxhash64("h1", "h2"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("comp", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "side", "h1", "h2", "n", "copies", "hs")
    rows = rows.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return rows.mapInArrow(_link_counts(num, den), "h1 long, h2 long, n long, links long").groupBy("h1", "h2", "n").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id.

    docs needs doc_id (an integer) and text; other columns are not read. Words
    are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set is the distinct
    k-word shingles, the whole sequence if there are fewer words. Two documents
    link when den * intersection >= num * union; component_id is the smallest
    doc_id reachable. Null or empty texts have no shingles and link with
    nothing. A null doc_id keeps a null component_id. Rows that repeat a doc_id
    are one document: their components are merged under the smallest id.
    """
    return _join(docs, k, num, den, count=False)


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """As jaccard_components, with n_links after n_shingles: with how many other rows that have a doc_id a row links.

    A row without doc_id or without shingles has none.
    """
    return _join(docs, k, num, den, count=True)


def _join(docs: DataFrame, k: int, num: int, den: int, count: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prof = materialise(text.mapInArrow(_profile(k), "doc_id long, n long, h1 long, h2 long, sk binary"), "sketches")
    known = prof.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    many = materialise(classes.where("copies > 1"), "many")
    member = known.select("doc_id", "h1", "h2", "n").join(many.drop("copies"), ["h1", "h2", "n"])
    # a doc_id that stands in several rows may be in several classes: all its texts count, whichever class it represents
    twice = materialise(known.groupBy("doc_id").agg(F.countDistinct("h1", "h2", "n").alias("c")).where("c > 1").select("doc_id"), "twice")
    copies = materialise(member.where("doc_id <> rep").select("doc_id").distinct().join(twice, "doc_id", "left_anti"), "copies")
    most = prof.agg(F.max("n")).first()[0] or 1
    reps = text.where("text IS NOT NULL AND doc_id IS NOT NULL").join(maybe_broadcast(copies, copies.count()), "doc_id", "left_anti")
    canopies = _canopies(reps, k, num, den, int(most))
    edges = labels = done = None  # done: sets already at hand

    def sets_of(ids: DataFrame) -> None:
        """Adds the sets of documents that are not at hand yet."""
        nonlocal done
        ids = materialise(ids if done is None else ids.join(done.select("doc_id"), "doc_id", "left_anti"), "ids")
        if n := ids.count():
            sets = materialise(text.where("text IS NOT NULL").join(maybe_broadcast(ids, n), "doc_id", "left_semi").mapInArrow(_set_rows(k), "doc_id long, hs binary"), "sets")
            done = sets if done is None else done.unionByName(sets)

    def link(found: DataFrame) -> None:
        nonlocal edges, labels
        found = materialise(found, "links")
        if found.limit(1).count():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)

    size_ok = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    sk = known.select("doc_id", "n", "sk")
    for turn in range(STARS):
        if turn == 0:
            pairs = canopies.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"), F.col("n").alias("na"), F.col("cn").alias("nb"))
        else:
            live = _labelled(canopies, labels, F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("o"), "doc_id", "n", "comp")).alias("m"))
            pairs = live.where("comp <> m.comp").select(F.col("doc_id").alias("a"), F.col("m.doc_id").alias("b"), F.col("n").alias("na"), F.col("m.n").alias("nb"))
        pairs = pairs.where(size_ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        close = pairs.join(sk.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sk").alias("sa")), "a").join(sk.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("sb")), "b")
        close = materialise(close.mapInArrow(_near(num, den), "a long, b long"), "close")
        sets_of(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct())
        if done is not None:
            found = close.join(done.select(F.col("doc_id").alias("a"), F.col("hs").alias("ha")), "a").join(done.select(F.col("doc_id").alias("b"), F.col("hs").alias("hb")), "b").select("a", "b", "ha", "hb")
            link(found.mapInArrow(_exact(num, den), "a long, b long"))
    live = materialise(_labelled(canopies, labels).drop("cn"), "open")
    rows = _in_blocks(live.join(known.select("doc_id", "sk").mapInArrow(_folded, "doc_id long, f binary").dropDuplicates(["doc_id"]), "doc_id"))
    alike = _dealt(rows, "doc_id", "n", "comp", "main", "side", "f").mapInArrow(_alike(num, den), "centre long, doc_id long")
    alike = materialise(alike.distinct(), "alike")
    sets_of(alike.select("doc_id").distinct())
    if done is not None:
        rows = _in_blocks(live.join(alike, ["centre", "doc_id"])).join(done, "doc_id")
        link(_dealt(rows, "doc_id", "n", "comp", "main", "side", "hs").mapInArrow(_forest(num, den), "a long, b long"))
    links = known.join(twice, "doc_id", "left_semi").join(classes, ["h1", "h2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialise(links.distinct(), "repeats")
    if links.limit(1).count():
        edges = links if edges is None else edges.unionByName(links)
        labels = components(edges)
    if labels is None:
        labels = spark.createDataFrame([], "node long, comp long")
    to = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 OR comp IS NOT NULL").select("h1", "h2", "n", "rep", "copies", F.coalesce("comp", "rep").alias("comp"))
    if count:
        to = materialise(to, "members")
        more = to.join(known.join(twice, "doc_id", "left_semi").select("h1", "h2", "n"), ["h1", "h2", "n"], "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        sets_of(more)
        links = F.col("copies") - 1
        if done is not None:
            to = to.join(materialise(_count_links(done, to, num, den), "counts"), ["h1", "h2", "n"], "left")
            links = links + F.coalesce("links", F.lit(0))
        to = to.withColumn("links", links)
    out = prof.select("doc_id", "n", "h1", "h2").join(to.drop("rep", "copies"), ["h1", "h2", "n"], "left")
    null = F.col("doc_id").isNull()
    n_links = [F.when(null | (F.col("n") == 0), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links")] if count else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), *n_links, F.when(null, F.lit(None).cast("long")).otherwise(F.coalesce("comp", "doc_id")).alias("component_id"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The registered query: 3-word shingles, 90 of 100, over all documents, with the number of links."""
    from .common import table

    return jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


#: Word sets by an inverted list of each set's rarest shingles (a pair that links shares one of the first n - ceil(0.9 n) + 1
#: in one order of all shingles), decided by whole intersections. Every doc_id occurs once in the tables.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), d AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), one AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM d
), rare AS (SELECT g, count(*) AS c FROM one GROUP BY g
), lead AS (
  SELECT doc_id, g, n FROM one JOIN rare USING (g) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c, g) <= n - (90 * n + 99) // 100 + 1
), pair AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM lead a JOIN lead b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), half AS (
  SELECT a, b FROM (SELECT p.a, p.b, len(x.s) + len(y.s) AS n, len(list_intersect(x.s, y.s)) AS both_n FROM pair p JOIN d x ON x.doc_id = p.a JOIN d y ON y.doc_id = p.b) WHERE 100 * both_n >= 90 * (n - both_n)
), link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), links AS (SELECT a, count(*) AS n FROM link GROUP BY a
), lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(n, 0) AS n_links, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN links ON links.a = doc_id LEFT JOIN lowest ON lowest.a = doc_id
"""


def stage_ngram_join(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents (5-word shingles, 80 of 100) the one of smallest doc_id stays.

    Documents without words are in no group and stay, and so do rows without doc_id.
    Rows that repeat a doc_id are one document: all its different texts stay, or none;
    of rows with equal doc_id and text the one whose other columns come first as JSON.
    """
    parts = jaccard_components(docs).select("doc_id", "component_id").where("component_id <> doc_id").select("doc_id").distinct()
    parts = materialise(parts, "dropped")
    names = [f"`{c}`" for c in docs.columns]
    out = docs.join(maybe_broadcast(parts, parts.count()), "doc_id", "left_anti").select(*names)
    twice = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    n = twice.count()
    if n:
        ids = maybe_broadcast(twice, n)
        row = F.struct(*names)
        again = out.join(ids, "doc_id", "left_semi").groupBy("doc_id", F.col("text").alias("by")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        out = out.join(ids, "doc_id", "left_anti").select(*names).unionByName(again.select(*names))
    return out.select(*names)
