"""Rules on interaction lists and the work they ask for: near rules, empty boxes, counts by kind, modelled costs.

Inputs are boxes(key, is_leaf) and lists(kind, target, source) of `tree`, and points by
leaf(leaf). All is equality joins and sums of a row a box or pair; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import morton as mk

#: Kinds of work, in the order in which an evaluation does them.
KINDS = ("P2M", "M2M", "M2L", "P2L", "L2L", "L2P", "M2P", "P2P")


def box_counts(boxes: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """key, is_leaf, sources, targets: the points of every box's whole subtree, 0 where there are none."""
    one = lambda df, s, t: df.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", (F.col("n") * s).alias("sources"), (F.col("n") * t).alias("targets"))
    leaves = one(sources, 1, 0).unionByName(one(targets, 0, 1))
    sums = leaves.select(F.explode(mk.ancestors(F.col("leaf"))).alias("key"), "sources", "targets").groupBy("key").agg(F.sum("sources").alias("sources"), F.sum("targets").alias("targets"))
    return boxes.select("key", "is_leaf").join(sums, "key", "left").na.fill(0, ["sources", "targets"])


def _counted(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """lists with both leaf flags, the source's sources and the target's targets."""
    s = counts.select(F.col("key").alias("source"), F.col("is_leaf").alias("s_leaf"), "sources")
    t = counts.select(F.col("key").alias("target"), F.col("is_leaf").alias("t_leaf"), "targets")
    return lists.select("kind", "target", "source").join(s, "source").join(t, "target")


def leaf_pairs(lists: DataFrame, counts: DataFrame, kinds: tuple[str, ...] = ("W", "X")) -> DataFrame:
    """kind, target, source, sources, targets: the pairs of far lists between two leaves, which a near rule may decide on."""
    return _counted(lists.where(F.col("kind").isin(*kinds)), counts).where("s_leaf AND t_leaf").select("kind", "target", "source", "sources", "targets")


def converted(lists: DataFrame, counts: DataFrame, rule: Callable[[Column, Column, Column], Column], kinds: tuple[str, ...] = ("W", "X")) -> DataFrame:
    """lists in which the leaf pairs that rule(kind, sources, targets) holds for are near pairs (U); a null decision is none."""
    near = leaf_pairs(lists, counts, kinds).where(rule(F.col("kind"), F.col("sources"), F.col("targets"))).select("kind", "target", "source", F.lit(True).alias("near"))
    flagged = lists.select("kind", "target", "source").join(near, ["kind", "target", "source"], "left")
    return flagged.select(F.when(F.col("near"), F.lit("U")).otherwise(F.col("kind")).alias("kind"), "target", "source")


def by_products(least: int) -> Callable[[Column, Column, Column], Column]:
    """A rule: a pair is near if summing it directly takes fewer than ``least`` products of points."""
    return lambda kind, sources, targets: sources * targets < least


def without_empty(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """lists without pairs whose source holds no source or whose target holds no target: their terms are exact zeros or read by none."""
    return _counted(lists, counts).where("sources > 0 AND targets > 0").select("kind", "target", "source")


def left_out(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """kind, without_targets, without_sources: how many pairs `without_empty` leaves out; those that lack both count for targets."""
    c = _counted(lists, counts)
    return c.groupBy("kind").agg(F.sum((F.col("targets") == 0).cast("long")).alias("without_targets"), F.sum(((F.col("targets") > 0) & (F.col("sources") == 0)).cast("long")).alias("without_sources"))


def work(lists: DataFrame, counts: DataFrame, unit: str = "pairs") -> DataFrame:
    """key, kind, n: the work on each box by kind, 0 left out.

    P2M: sources of a leaf. M2M: children of a split box. M2L: pairs of V (unit "boxes": 1 if
    any). P2L: sources of the X list. L2L: 1 from level 3 on. L2P: targets of a leaf. M2P:
    targets times boxes of the W list. P2P: targets times sources of the leaf and its U list.
    """
    if unit not in ("pairs", "boxes"):
        raise ValueError("unit must be pairs or boxes")
    c = _counted(lists, counts)
    far = c.groupBy("target", "kind").agg(
        F.count("*").alias("pairs"), F.sum("sources").alias("sources"), F.first("targets").alias("targets"), F.first("t_leaf").alias("t_leaf")
    )
    listed = far.select(
        F.col("target").alias("key"),
        F.create_map(F.lit("V"), F.lit("M2L"), F.lit("X"), F.lit("P2L"), F.lit("W"), F.lit("M2P"), F.lit("U"), F.lit("P2P"))[F.col("kind")].alias("kind"),
        F.when(F.col("kind") == "V", F.col("pairs") if unit == "pairs" else F.lit(1))
        .when(F.col("kind") == "X", F.col("sources"))
        .when(F.col("kind") == "W", F.col("targets") * F.col("pairs"))
        .otherwise(F.col("targets") * F.col("sources"))
        .cast("long")
        .alias("n"),
    )
    own = lambda kind, n, on: F.struct(F.lit(kind).alias("kind"), F.when(on, n).otherwise(0).cast("long").alias("n"))
    leaf = F.col("is_leaf")
    boxes = counts.select(
        "key",
        F.explode(
            F.array(
                own("P2M", F.col("sources"), leaf),
                own("M2M", F.lit(8), ~leaf),
                own("L2L", F.lit(1), mk.level("key") >= 3),
                own("L2P", F.col("targets"), leaf),
                own("P2P", F.col("sources") * F.col("targets"), leaf),
            )
        ).alias("w"),
    ).select("key", "w.kind", "w.n")
    return listed.unionByName(boxes).groupBy("key", "kind").agg(F.sum("n").alias("n")).where("n > 0")


def by_block(work_: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, kind, n: work summed over the boxes in each of blocks(key), which must not hold one another; boxes above all are null's."""
    at = blocks.select(F.col("key").alias("block"))
    up = work_.select("key").distinct().select("key", F.explode(mk.ancestors(F.col("key"))).alias("block")).join(at, "block")
    return work_.join(up, "key", "left").groupBy("block", "kind").agg(F.sum("n").alias("n"))


class CostModel:
    """Seconds (or any unit) a unit of work: finite, not negative, not all 0; kinds that are not named cost nothing."""

    def __init__(self, unit: str = "pairs", **alphas: float):
        if set(alphas) - set(KINDS):
            raise ValueError(f"kinds are {', '.join(KINDS)}")
        if any(not math.isfinite(a) or a < 0 for a in alphas.values()) or not any(alphas.values()):
            raise ValueError("constants must be finite and not negative, and one must be positive")
        self.unit, self.alphas = unit, alphas

    def cost(self, work_: DataFrame, by: str = "key") -> DataFrame:
        """by, weight: the modelled cost of each box or block: what `sets.recut` takes as the second weight."""
        alpha = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(a))) for k, a in self.alphas.items()], F.lit(0.0))
        return work_.groupBy(by).agg(F.sum(alpha * F.col("n")).alias("weight"))
