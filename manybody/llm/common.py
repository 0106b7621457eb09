"""Shared plumbing of the training-data operators: tables, work folders, batches, components.

Work tables are written as Parquet below ``spark.checkpoint.dir`` (shared by
all executors), never kept in executor memory: a lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast: at about 50 bytes a row this stays below 20 MB.
BROADCAST_ROWS = 200_000
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared work folder, with its scheme; a local one only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="manybody-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:  # else a task's own writer would take another file system than Spark's
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a work table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256, size: str = "16m") -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a batch of long texts fits a worker's memory.

    The session keeps the bounds: plans read them when they run, which is after this call.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it as long as a column has it (upper and lower case count alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts df only if its counted rows are within the bound; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= bound else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): a row (node, comp) for every node of an edge.

    comp is the smallest node reachable. Each round takes the least label of the
    neighbours and then follows labels once (pointer jumping), so chains shrink
    geometrically. Sums of partial minima keep hubs from meeting in one task.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    for _ in range(max_rounds):
        least = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(least.withColumnRenamed("a", "node"), "node", "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = step.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("next"), F.col("comp").alias("was"))
        new = materialise(new, "labels")
        labels = new.select("node", F.col("next").alias("comp"))
        if new.where("next <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("components: no fixpoint")


def gathered(batches, most: int):
    """Record batches joined until they hold ``most`` bytes."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
