"""Where intermediate tables and checkpoints go: storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a file and of a shuffle that a task takes when a table is written; row groups, which no task divides, are
#: about as large as a file's share.
SPLIT = 8 << 20
SHARE = 4 << 20
MOST_SHARES = 4000
#: Bytes that a table may have to be broadcast unasked: a column of ids takes far more memory than its file.
SMALL = 1 << 20
#: Spark takes sizes of this order for tables of unknown size.
UNKNOWN = 1 << 60


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the context was given. Where neither is set, a folder of this user's own
    on a single machine, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"weftgraph-{os.getuid()}")
    context.setCheckpointDir(own)
    return own


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other values, which it gets back at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet on shared storage and read again: computed once, and still there when
    an executor is lost. The shuffles that made it are deleted at once. Tasks take a fixed share of files and
    shuffles, so that there are more of them, not larger ones, when the input grows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // SHARE, MOST_SHARES))
    values = {_CLEANUP: "true", "spark.sql.files.maxPartitionBytes": SPLIT, "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHARE, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": shares}
    if not spark.conf.get(_BROADCAST).startswith("-"):
        values[_BROADCAST] = SMALL
    with _set(spark, {k: str(v) for k, v in values.items()}):
        df.write.option("parquet.block.size", str(2 * SPLIT)).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote; nothing made from them can be computed any more."""
    for t in tables:
        spark, path = t.sparkSession, t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """df with each row's place in an order, from 0. Ranges of the order are sorted and counted apart, in one
    shuffle; only one row a range meets in one task."""
    at = F.monotonically_increasing_id()  # the range above 33 bits of the place within it
    spread = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    part = F.shiftright("_at", 33)
    before = spread.groupBy(part.alias("_range")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).drop("_n")
    # a row a range
    return spread.withColumn("_range", part).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_before", "_at")
