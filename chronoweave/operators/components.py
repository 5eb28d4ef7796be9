"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.sizes import sent_if_small


def shared_folder(spark: SparkSession) -> None:
    """Make sure there is a folder for checkpoints: the session's ``spark.checkpoint.dir``. Only where all runs in one process
    (``local``, as in tests) and none is set, a temporary one is made; on a cluster a missing setting is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir is not set: checkpoints need a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chronoweave-")
        context.setCheckpointDir(folder)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    rdd = df._jdf.queryExecution().logical().rdd()
    at = rdd.getCheckpointFile()
    if at.isDefined():
        jvm, path = df.sparkSession.sparkContext._jvm, at.get()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component) of every node that has an edge to another node.

    Each round links all larger neighbours of a node to its smallest one, then the rest likewise; the number of rounds grows
    with the logarithm of the longest path, and ends as soon as the links are stars (every node has one link, to a node that
    has none). Before, it is tried whether the smallest neighbour of each node tells the component already, as in a graph of
    cliques: it does if both ends of every link have the same one. The lineage is cut every round by checkpoint(), which the loss of an executor
    doesn't touch, and the round before is deleted. Edges with a null end and edges from a node to itself are left out. If
    after ``rounds`` the links are no stars, components would be unfinished: that is an error.
    """
    shared_folder(edges.sparkSession)
    links = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    links, n = _kept(links)
    if n and (stars := _if_all_agree(links)) is not None:
        drop_checkpoint(links)
        links = stars
    elif n:
        for _ in range(rounds):
            done, (links, _) = links, _kept(_round(links))
            drop_checkpoint(done)
            if _are_stars(links):
                break
        else:
            raise RuntimeError(f"components are unfinished after {rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _if_all_agree(links: DataFrame) -> DataFrame | None:
    """Links of all nodes to their smallest neighbours, if both ends of every link have the same one; else None."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).checkpoint()
    sent = sent_if_small(lowest)
    ends = links.join(sent.withColumnRenamed("m", "ma"), "a").join(sent.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
    if ends.where("ma <> mb").limit(1).isEmpty():
        return lowest.where("a <> m").select("a", F.col("m").alias("b"))
    drop_checkpoint(lowest)
    return None


def _round(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.where("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node without any."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def _kept(links: DataFrame) -> tuple[DataFrame, int]:
    """The links with their lineage cut, and their number, observed on the way."""
    seen = Observation()
    kept = links.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    return kept, seen.get["n"]
