"""Shared plumbing of the training-data operators: tables, lineage cuts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, ARROW_BYTES = "250", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: whole texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only a local master, whose driver is its executor, gets a folder of its own where none is named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/thalweg-{sc.applicationId}"
    return named.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's file system of path, and path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/thalweg/{name}-{uuid.uuid4().hex}"
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: short lineage that survives lost executors."""
    path = own_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def drop(*tables: DataFrame, shuffles: bool = False) -> None:
    """Delete tables that cut() has written; everything made of them must have been written itself. shuffles: also free()."""
    for t in tables:
        fs, where = hadoop_path(t.sparkSession, t.written_to)
        fs.delete(where, True)
    if shuffles:
        free(tables[0].sparkSession)


def free(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only so Spark deletes the shuffle files of jobs that are over."""
    spark._jvm.System.gc()


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


BROADCAST, SALTS = 1_000_000, 16


def sent(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few enough (8 MB of them), else joined by shuffle; ids should be cut already."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """rows with the value of table(key, value), one row for each key, null where there is none.

    One key may hold any share of rows, so they never go to one task by it: the table is broadcast while it
    is small, and repeated for SALTS shares of rows beyond that.
    """
    table = cut(table.select(key, value), "lookup")
    if table.count() <= BROADCAST:
        return rows.join(F.broadcast(table), key, "left")
    shares = table.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("share", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(shares, [key, "share"], "left").drop("share")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of edges(a, b); component_id is the smallest node reachable.

    Each round alternates neighbour minima and pointer jumping, so chains of n nodes end in O(log n)
    rounds. Groupings are minima with map-side combine, labels are looked up without a shuffle by label,
    and the join with the edges is between written tables, so a hub can be split; the driver sees only the
    number of changed labels. Tables of earlier rounds are deleted as they are used up.
    """
    both = cut(
        edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "edges",
    )
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        hooked = cut(labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("best")), "heard")
        if not hooked.where("best < label").limit(1).count():
            break  # no neighbours differ
        # a label is itself a node: what its neighbours heard also moves the nodes that carry it
        roots = hooked.where("best < label").groupBy("label").agg(F.min("best").alias("root_best"))
        moved = looked_up(hooked, "label", roots, "root_best").select("node", F.least("best", F.coalesce("root_best", "best")).alias("best"))
        moved = cut(moved, "hook")
        jump = moved.where("best < node").select(F.col("node").alias("best"), F.col("best").alias("far"))
        jump = jump.join(moved.select("best").distinct(), "best", "left_semi")
        new = cut(looked_up(moved, "best", jump, "far").select("node", F.least("best", F.coalesce("far", "best")).alias("label")), "labels")
        drop(labels, hooked, moved)
        labels = new
    else:
        raise RuntimeError("components did not settle")
    drop(both)
    return labels.select("node", F.col("label").alias("component_id"))
