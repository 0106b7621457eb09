"""Algebra on sets of Morton keys, prefix sums, and cuts of weighted blocks into ranges.

Sets are DataFrames with a column key. Everything is an equality join, an anti-join
or a window within a range of keys; nothing is collected but a row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morton as mk
from ..work import saved
from . import tree


def proper_ancestors(keys: DataFrame) -> DataFrame:
    """All boxes that hold a key and are not that key, each once; the root among them unless it is the only key."""
    return keys.select(F.explode(mk.proper_ancestors("key")).alias("key")).distinct()


def with_ancestors(keys: DataFrame) -> DataFrame:
    return keys.select("key").union(proper_ancestors(keys)).distinct()


def completed(keys: DataFrame) -> DataFrame:
    """The coarsest complete linear octree that has the finest of keys as leaves: the children of their ancestors that are none themselves.

    An empty set gives the root.
    """
    above = saved(proper_ancestors(keys), "above")
    root = keys.sparkSession.range(1).select(F.lit(mk.ROOT).cast("long").alias("key"))
    nodes = above.select(F.explode(mk.children("key")).alias("key")).unionByName(root)
    return nodes.join(above, "key", "left_anti")


def gaps(keys: DataFrame) -> DataFrame:
    """The coarsest boxes that fill what a linear set leaves of the domain: between neighbouring keys, before the first, after the last."""
    return completed(keys).join(keys.select("key").distinct(), "key", "left_anti")


def is_linear(keys: DataFrame) -> bool:
    """Whether no key repeats or holds another."""
    twice = keys.groupBy("key").count().where("count > 1").select("key")
    return not twice.unionByName(keys.select("key").join(proper_ancestors(keys), "key", "left_semi")).limit(1).count()


def is_complete(keys: DataFrame) -> bool:
    """Whether the keys tile the domain: linear, and of the domain's volume."""
    return is_linear(keys) and tree.complete(keys)


def is_valid_tree(leaves: DataFrame) -> bool:
    """Whether leaves are linear, complete and 2:1 balanced over faces, edges and corners."""
    if not is_complete(leaves):
        return False
    return tree.is_balanced(leaves.select("key", F.lit(True).alias("is_leaf")).unionByName(proper_ancestors(leaves).withColumn("is_leaf", F.lit(False))))


def essential(lists: DataFrame, own: DataFrame) -> DataFrame:
    """The keys that work on the boxes own (leaves of one part) needs: themselves, their ancestors, and all sources of their lists."""
    mine = with_ancestors(own)
    return mine.union(lists.join(mine.withColumnRenamed("key", "target"), "target", "left_semi").select(F.col("source").alias("key"))).distinct()


def coarse_blocks(keys: DataFrame, most: int, max_level: int = mk.DEPTH) -> DataFrame:
    """The largest boxes with at most ``most`` of keys(key16) each: key, n; a box of max_level stays whatever it holds."""
    counts = keys.groupBy("key16").agg(F.count("*").alias("c")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_level)), lambda v: mk.ancestor(F.col("key16"), v))).alias("key"), "c").groupBy("key").agg(F.sum("c").alias("n"))
    counts = saved(counts, "counts")
    above = counts.select(F.col("key").alias("up"), F.col("n").alias("up_n"))
    rows = counts.withColumn("up", mk.parent("key")).join(above, "up", "left")
    return rows.where(((F.col("n") <= most) | (mk.level("key") == max_level)) & (F.col("up_n").isNull() | (F.col("up_n") > most))).select("key", "n")


def range_partitioned(df: DataFrame, by: str = "key", parts: int | None = None) -> DataFrame:
    """Rows sorted by a column, a range of it in each partition."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, by).sortWithinPartitions(by)


def prefix_sums(df: DataFrame, by: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows of smaller ``by`` (which must be unique): an exclusive prefix sum, CSR offsets.

    Ranges are summed apart; the ranges' offsets are a row a partition.
    """
    ranged = saved(range_partitioned(df, by).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_s"))
    offset = sums.withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")  # a row a partition
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, within).join(F.broadcast(offset), "_part").withColumn(name, F.col(name) + F.col("_o")).drop("_part", "_o")


def rank_in_group(df: DataFrame, group: str, by: str, name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, among the rows of its group in the order of by."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(by)) - 1)


def stratified(df: DataFrame, group: str, key: str, k: int, seed: int = 3) -> DataFrame:
    """k rows of each group (all of a smaller one), chosen by a hash of key: the same whatever the partitioning."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def cut_at(blocks: DataFrame, weight: str, parts: int) -> list[int]:
    """Cuts of blocks(key, weight) in key order into parts of about equal weight: the first key of each part but the first.

    Each of the parts - 1 ideal bounds moves to the nearest boundary between blocks, on ties to the later.
    """
    run = saved(prefix_sums(blocks.select("key", weight), "key", weight), "prefix")
    total = run.agg(F.sum(weight)).first()[0] or 0
    bounds = run.sparkSession.createDataFrame([(i, i * total / parts) for i in range(1, parts)], "i int, at double") if parts > 1 and total else None
    if bounds is None:
        return []
    width = F.broadcast(bounds)
    # the block that an ideal bound falls in decides between its two ends
    hit = run.join(width, (F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col(weight)))
    later = F.col("before") + F.col(weight) - F.col("at") <= F.col("at") - F.col("before")
    rows = {r.i: (r.key, r.later) for r in hit.select("i", "key", later.alias("later")).collect()}  # parts - 1 rows at most
    after = {r.key: r.next for r in run.join(F.broadcast(run.sparkSession.createDataFrame([(k,) for k, late in set(rows.values()) if late] or [(-1,)], "k long")), F.col("key") >= F.col("k")).groupBy(F.col("k").alias("key")).agg(F.min(F.when(F.col("key") > F.col("k"), F.col("key"))).alias("next")).collect()} if rows else {}
    found = [after.get(k) if late else k for k, late in (rows[i] for i in sorted(rows))]
    return sorted({x for x in found if x is not None})


def owner(key: Column, cuts: list[int]) -> Column:
    """The part that a key belongs to, from the cuts alone: how many of them are at or below it."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= key)) if cuts else F.lit(0)


def owners_within(key: Column, cuts: list[int]) -> Column:
    """All parts that own something of a box: those of its first to its last finest key."""
    return F.sequence(owner(key, cuts), owner(mk.last_descendant(key), cuts))


def imbalance(blocks: DataFrame, weight: str, cuts: list[int]) -> float:
    """The heaviest part's weight over the mean part's."""
    r = blocks.groupBy(owner(F.col("key"), cuts).alias("part")).agg(F.sum(weight).alias("w")).agg(F.max("w"), F.sum("w")).first()
    return 1.0 if not r[1] else r[0] * (len(cuts) + 1) / r[1]


def recut(blocks: DataFrame, first: str, second: str, parts: int, least_gain: float = 0.05) -> list[int]:
    """Cuts by the weight ``first``, unless cuts by ``second`` lower the imbalance of ``second`` by a share of least_gain at least."""
    one, two = cut_at(blocks, first, parts), cut_at(blocks, second, parts)
    return two if imbalance(blocks, second, two) <= (1 - least_gain) * imbalance(blocks, second, one) else one
