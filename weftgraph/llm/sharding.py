"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots; only the small slot-to-shard map ever
changes. Bytes are added up per slot, and rebalancing edits the map: shards over the target give
up their smallest slots, and these fill the gaps of the others. The map is stored on shared storage
under one folder a version, so a reader can keep to the version it began with. A store may be
rebalanced again and again, each time from its latest version, also to more or fewer shards.

Everything that goes to all executors is the map, whose size is the number of slots and not that
of the data. Moving slots is a window over that map, so it is a plan like any other.

Edge cases: a null doc_id hashes like the empty string; a null text has 0 bytes; repeated rows
count each and share a slot; an empty table gives an empty result and leaves the first map as it
is; slots without bytes never move; slots with equal bytes are taken by slot number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import scratch_path

N_SLOTS = 4096
N_SHARDS = 32
TOLERANCE_PERCENT = 5


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot from 32 bits of MD5, which every engine computes alike."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n_slots)).cast("int")


def slot_bytes(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(slot, bytes) for all slots, those without records too."""
    held = docs.select(slot_of(F.col("doc_id"), n_slots).alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("b")).groupBy("slot").agg(F.sum("b").alias("bytes"))
    every = docs.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(held, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def initial_map(spark: SparkSession, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """(slot, shard): equal ranges of slots."""
    return spark.range(n_slots).select(F.col("id").cast("int").alias("slot"), F.expr(f"cast(id * {n_shards} div {n_slots} as int)").alias("shard"))


def rebalance(slots: DataFrame, current: DataFrame, n_shards: int = N_SHARDS, tolerance_percent: int = TOLERANCE_PERCENT) -> DataFrame:
    """The edited map (slot, shard, moved).

    The target is an equal share, rounded up. A shard over the target by more than the tolerance
    keeps its largest slots while their running sum fits the target. Slots given up, largest
    first, are laid end to end along the gaps of the shards, and each goes to the shard whose gap
    holds its middle. The gaps are at least as long together as what is given up."""
    spark = slots.sparkSession
    # The map has a row a slot: one partition is right for its windows, at any size of the data.
    held = slots.join(current, "slot").coalesce(1)
    total = W.partitionBy(F.lit(0))
    by_size = W.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0)
    marked = (
        held.withColumn("target", F.expr(f"(sum(bytes) over (partition by 0) + {n_shards - 1}) div {n_shards}"))
        .withColumn("load", F.sum("bytes").over(W.partitionBy("shard")))
        .withColumn("gone", F.col("shard") >= n_shards)
        .withColumn("out", F.col("gone") & (F.col("bytes") > 0) | (F.col("load") * 100 > F.col("target") * (100 + tolerance_percent)) & (F.sum("bytes").over(by_size) > F.col("target")) & (F.col("bytes") > 0))
    )
    kept = marked.groupBy("shard").agg(F.sum(F.when(F.col("out"), 0).otherwise(F.col("bytes"))).alias("kept"), F.max("target").alias("t"))
    every = spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left")
    gap = every.select("shard", F.greatest(F.coalesce("t", F.max("t").over(total), F.lit(0)) - F.coalesce("kept", F.lit(0)), F.lit(0)).alias("gap"))
    gap = gap.select(F.col("shard").alias("to_shard"), "gap", F.sum("gap").over(W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, 0)).alias("hi")).where("gap > 0")
    along = W.partitionBy(F.lit(0)).orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0)
    moving = marked.where("out").select("slot", (F.sum("bytes").over(along) * 2 - F.col("bytes")).alias("middle2"))
    placed = moving.join(F.broadcast(gap), (F.col("middle2") >= (F.col("hi") - F.col("gap")) * 2) & (F.col("middle2") < F.col("hi") * 2)).select("slot", "to_shard")
    # of shards that are no more, slots without bytes go anywhere
    now = F.coalesce("to_shard", F.when(F.col("shard") >= n_shards, F.pmod("slot", F.lit(n_shards))).otherwise(F.col("shard")))
    return held.join(placed, "slot", "left").select("slot", now.alias("shard"), (now != F.col("shard")).alias("moved"))


class SlotMapStore:
    """Versions of a slot map, each an immutable folder `version=N` on shared storage."""

    _schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "slot-map")

    def versions(self) -> list[int]:
        """Versions that were written to their end."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        folders = [x.getPath() for x in files.listStatus(place)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getName()[8:]) for x in folders if x.getName().startswith("version=") and files.exists(done(x, "_SUCCESS")))

    def write(self, version: int, slot_map: DataFrame) -> None:
        """Fails if the version is there already: a version never changes."""
        if version in self.versions():
            raise FileExistsError(f"version {version} of {self.path} exists already")
        slot_map.select("slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/version={version}")


def shard(docs: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS, tolerance_percent: int = TOLERANCE_PERCENT, store: SlotMapStore | None = None) -> DataFrame:
    """(doc_id, slot, shard, map_version, moved) for each record after one rebalancing of the store's latest map. The
    store keeps its number of slots."""
    store = store or SlotMapStore(docs.sparkSession)
    if not store.versions():
        store.write(1, initial_map(docs.sparkSession, n_slots, n_shards))
    last = store.versions()[-1]
    old = store.read(last)
    if (held := old.count()) != n_slots:
        raise ValueError(f"the store has {held} slots, not {n_slots}")
    store.write(last + 1, rebalance(slot_bytes(docs, n_slots), old, n_shards, tolerance_percent))
    now = store.read(last + 1).join(old.withColumnRenamed("shard", "before"), "slot")
    routed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), slot_of(F.col("doc_id"), n_slots).alias("slot"))
    # n_slots rows, whatever the size of the data
    return routed.join(F.broadcast(now), "slot").select("doc_id", "slot", "shard", F.lit(last + 1).alias("map_version"), (F.col("shard") != F.col("before")).alias("moved"))


def oracle(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS, tolerance_percent: int = TOLERANCE_PERCENT) -> str:
    return f"""
WITH r AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {n_slots})::INT AS slot, coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
s AS (SELECT x.slot, coalesce(sum(r.b), 0)::BIGINT AS bytes, (x.slot * {n_shards} // {n_slots})::INT AS shard FROM (SELECT range::INT AS slot FROM range({n_slots})) x LEFT JOIN r ON r.slot = x.slot GROUP BY x.slot),
m AS (SELECT *, ((sum(bytes) OVER () + {n_shards - 1}) // {n_shards})::BIGINT AS target, sum(bytes) OVER (PARTITION BY shard) AS load, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) AS run FROM s),
o AS (SELECT *, load * 100 > target * {100 + tolerance_percent} AND run > target AND bytes > 0 AS out FROM m),
g AS (SELECT shard, greatest(max(target) - sum(CASE WHEN out THEN 0 ELSE bytes END), 0) AS gap FROM o GROUP BY shard),
h AS (SELECT shard AS to_shard, gap, sum(gap) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING) AS hi FROM g),
v AS (SELECT slot, 2 * sum(bytes) OVER (ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) - bytes AS mid FROM o WHERE out),
p AS (SELECT v.slot, h.to_shard FROM v JOIN h ON h.gap > 0 AND v.mid >= 2 * (h.hi - h.gap) AND v.mid < 2 * h.hi)
SELECT r.doc_id, r.slot, coalesce(p.to_shard, s.shard)::INT AS shard, 2 AS map_version, coalesce(p.to_shard, s.shard) <> s.shard AS moved
FROM r JOIN s ON s.slot = r.slot LEFT JOIN p ON p.slot = r.slot"""
