"""Adaptive, 2:1-balanced octrees and their interaction lists, as DataFrames.

Nothing is collected but the domain (six numbers); tables of boxes hold about one
row for every leaf's worth of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morton as mk
from ..work import saved


def domain_of(*tables: DataFrame) -> tuple[float, ...]:
    """The cube around all points(x, y, z): the extents' centre, the largest extent times 1 + 2^-16.

    No points, a null and a coordinate that is not finite are errors.
    """
    one = tables[0].select("x", "y", "z")
    for t in tables[1:]:
        one = one.unionByName(t.select("x", "y", "z"))
    r = one.agg(F.count("*").alias("n"), *[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max, F.count)]).first()
    if any(r[f"count_{a}"] < r["n"] for a in "xyz"):
        raise ValueError("a coordinate is null")
    low, high = [r[f"min_{a}"] for a in "xyz"], [r[f"max_{a}"] for a in "xyz"]
    if None in low or any(v != v or abs(v) == float("inf") for v in low + high):
        raise ValueError("points must be there and finite")
    side = max(b - a for a, b in zip(low, high, strict=True)) * (1 + 2.0**-16)
    if side <= 0:
        raise ValueError("the points' extent is 0")
    return tuple((a + b) / 2 - side / 2 for a, b in zip(low, high, strict=True)) + (side,) * 3


def keyed(points: DataFrame, domain, name: str = "key16") -> DataFrame:
    return points.withColumn(name, mk.point_key("x", "y", "z", domain))


def check_domain(domain, own) -> None:
    """A given domain must be a finite cube that holds the extents' cube ``own`` but for its margin of 2^-16."""
    if any(v != v or abs(v) == float("inf") for v in domain) or domain[3] <= 0 or not domain[3] == domain[4] == domain[5]:
        raise ValueError("the domain must be a finite cube")
    slack = own[3] * 2.0**-17
    if any(a + slack < b or a + w - slack > b + v for a, b, w, v in zip(own[:3], domain[:3], own[3:], domain[3:], strict=True)):
        raise ValueError("a point lies outside the domain")


#: Levels that are counted together: above the first slab's bottom partial sums leave few rows to shuffle.
SLAB = 5


def levels(keys: DataFrame, cap: int, max_level: int = mk.DEPTH, min_level: int = 0) -> DataFrame:
    """Boxes of the adaptive tree over keys(key16): key, level, is_leaf.

    A box is split while it holds more than cap distinct level-16 keys and is above
    max_level (or above min_level and not empty); a split box has all eight children.
    Slabs of SLAB levels are counted from the top; only keys in boxes that are split go on.
    """
    live = keys.select("key16").distinct()
    split = None
    for lo in range(0, max_level, SLAB):
        hi = min(lo + SLAB, max_level) - 1
        counts = live.select(F.explode(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda v: mk.ancestor(F.col("key16"), v))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        part = saved(counts.where((F.col("n") > cap) | (mk.level("key") < min_level)).select("key"), "split")
        split = part if split is None else split.unionByName(part)
        last = part.where(mk.level("key") == hi)
        if hi + 1 < max_level and not last.limit(1).count():
            break
        live = live.withColumn("key", mk.ancestor("key16", hi)).join(last, "key", "left_semi").select("key16")
    return _nodes(keys.select(F.lit(0).cast("long").alias("key")).where("false") if split is None else split)


def _nodes(split: DataFrame) -> DataFrame:
    """All boxes of a tree from those that are split."""
    root = split.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"))
    nodes = split.select(F.explode(mk.children("key")).alias("key")).unionByName(root)
    flagged = nodes.join(split.withColumn("is_split", F.lit(True)), "key", "left")
    return flagged.select("key", mk.level("key").alias("level"), F.col("is_split").isNull().alias("is_leaf"))


def balanced(boxes: DataFrame) -> DataFrame:
    """The least refinement of boxes in which touching leaves (26 directions) differ by one level at most.

    From the deepest level up, the neighbours of every split box must exist, so
    their parents are split as well: a small join-free pass a level over that level's boxes.
    """
    split = saved(boxes.where("NOT is_leaf").select("key", "level"), "split")
    deepest = split.agg(F.max("level")).first()[0]
    if deepest is None:
        return _nodes(split.select("key"))
    out, need = None, None
    ring, up = F.explode(mk.neighbours("key")).alias("key"), mk.parent("key").alias("key")  # large expressions: made once, not on every level
    for lev in range(deepest, -1, -1):
        level = split.where(F.col("level") == lev).select("key")
        level = level if need is None else saved(level.unionByName(need).distinct(), "split")
        out = level if out is None else out.unionByName(level)
        if lev:
            need = level.select(ring).select(up).distinct()
    return _nodes(out)


def is_balanced(boxes: DataFrame) -> bool:
    """Whether no leaf touches a leaf two or more levels finer: a neighbour of a split box must exist itself."""
    needed = boxes.where("NOT is_leaf").select(F.explode(mk.neighbours("key")).alias("key")).distinct()
    return needed.join(boxes.select("key"), "key", "left_anti").limit(1).count() == 0


def complete(leaves: DataFrame) -> bool:
    """Whether the volumes of linear leaves(key) sum to the domain's (`sets.is_complete` looks at linearity as well)."""
    total = leaves.agg(F.sum(F.pow(F.lit(8.0), mk.DEPTH - mk.level("key"))).alias("v")).first()["v"]
    return total == 8.0**mk.DEPTH


def linearised(keys: DataFrame) -> DataFrame:
    """keys(key) without duplicates and without those that hold another key."""
    distinct = keys.select("key").distinct()
    above = distinct.select(F.explode(mk.proper_ancestors("key")).alias("key")).distinct()
    return distinct.join(above, "key", "left_anti")


def leaf_levels(boxes: DataFrame) -> tuple[int, int]:
    """The least and the greatest level of the leaves."""
    return tuple(boxes.where("is_leaf").agg(F.min(mk.level("key")), F.max(mk.level("key"))).first())


def leaf_of(keys: DataFrame, boxes: DataFrame, name: str = "leaf", levels: tuple[int, int] | None = None) -> DataFrame:
    """keys(key16, ...) with the leaf that holds each: ancestors on the levels that have leaves are looked up by equality; one is a leaf.

    A null key (a point outside the domain) is an error; with ``levels``, those of the leaves, the caller has made sure of that.
    """
    leaves = boxes.where("is_leaf").select(F.col("key").alias(name))
    if levels is None and keys.where("key16 IS NULL").limit(1).count():
        raise ValueError("a point lies outside the domain")
    lo, hi = levels or leaf_levels(boxes)
    at = F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda v: mk.ancestor(F.col("key16"), v))
    distinct = keys.select("key16").distinct().select("key16", F.explode(at).alias(name)).join(leaves, name)
    return keys.join(distinct, "key16")


def _edges(boxes: DataFrame) -> DataFrame:
    """Each box with each same-level neighbour cell and whether that is a box: key, cell, exists, cell_leaf."""
    cells = boxes.select("key", "is_leaf", F.explode(mk.neighbours("key")).alias("cell"))
    found = boxes.select(F.col("key").alias("cell"), F.col("is_leaf").alias("cell_leaf"))
    return cells.join(found, "cell", "left")


def lists(boxes: DataFrame) -> DataFrame:
    """Interaction lists of a balanced tree: kind (U, V, W, X), target, source.

    U: leaves that touch the leaf. V: children of the parent's neighbours, apart
    from the box. W: children of a leaf's split neighbours, apart from it, their
    parent touching it. X: leaves that touch the parent, apart from the box.
    """
    e = saved(_edges(boxes), "edges")
    of_leaf = e.where("is_leaf")
    same = of_leaf.where("cell_leaf").select(F.lit("U").alias("kind"), F.col("key").alias("target"), F.col("cell").alias("source"))
    coarse = of_leaf.where("cell_leaf IS NULL").select(F.lit("U").alias("kind"), F.col("key").alias("target"), mk.parent("cell").alias("source")).distinct()
    fine = of_leaf.where("NOT cell_leaf").select("key", F.explode(mk.children("cell")).alias("c"))
    fine = fine.join(boxes.select(F.col("key").alias("c"), F.col("is_leaf").alias("c_leaf")), "c").withColumn("touch", mk.adjacent("key", "c"))
    finer = fine.where("touch").select(F.lit("U").alias("kind"), F.col("key").alias("target"), F.col("c").alias("source"))
    w = fine.where("NOT touch").select(F.lit("W").alias("kind"), F.col("key").alias("target"), F.col("c").alias("source"))
    family = e.where("NOT is_leaf AND cell_leaf IS NOT NULL").select(F.explode(mk.children("key")).alias("key"), "cell", "cell_leaf")
    v = family.where("NOT cell_leaf").select("key", F.explode(mk.children("cell")).alias("c")).where(~mk.adjacent("key", "c")).select(F.lit("V").alias("kind"), F.col("key").alias("target"), F.col("c").alias("source"))
    x = family.where("cell_leaf").where(~mk.adjacent("key", "cell")).select(F.lit("X").alias("kind"), F.col("key").alias("target"), F.col("cell").alias("source"))
    return same.unionByName(coarse).unionByName(finer).unionByName(w).unionByName(v).unionByName(x)


def leaf_statistics(boxes: DataFrame) -> DataFrame:
    """Leaves and boxes by level."""
    return boxes.groupBy("level").agg(F.count("*").alias("n_boxes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"))
