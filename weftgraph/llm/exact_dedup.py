"""Exact deduplication over an extendible-hash index kept on shared files.

Each text has a 64-bit key. The directory is addressed by the key's leading bits: a bucket that
holds more than `capacity` entries splits on its next bit, and the directory doubles when the
split needs one bit more than it has. Splitting needs only how many entries share a prefix, so
Spark sums the counts of prefixes and the directory grows on the driver to the state that inserting one
by one would reach. Prefixes have three bits more than buckets of full capacity need, so the depth follows the
number of entries; a bucket that is still too full then holds copies of few keys, which no split could part.

Entries go to the shared folder by owner task: a task owns a range of directory positions, hence of keys. Tasks that
read documents combine equal keys first; an owner sorts its range, adds up the entries of a key and writes
them as one, with the length of the key's chain. What it writes is at most one row a key, so a text with any
number of copies costs its owner a row for each batch that read one.

A chain of one is unique. Only texts whose key chains are fetched; they are grouped by key and by their
bytes, copies again combined before they are sent, so a collision of keys never merges two texts: they become
two links of one chain. Rows then find the first of their link by key, and by text where the key collides. Texts of
unique keys are never shuffled.

Edge cases: a null text equals nothing and is kept; the empty text is a text like any other;
of equal texts the row with the smallest doc_id stays, null doc_ids last; of rows equal in both,
one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, scratch_path, write_table

CAPACITY = 4096
#: Bits of prefixes beyond those that buckets of full capacity need
SPARE_BITS = 3
#: Directories of up to this many positions are broadcast (16 bytes each), else joined.
BROADCAST_POSITIONS = 1 << 20
#: Chained keys are broadcast up to this many (16 bytes each in the hashed relation), else shuffled.
BROADCAST_KEYS = 1 << 20


def grow_directory(prefix_counts: np.ndarray, capacity: int, max_depth: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(global depth, bucket id by directory position, local depth by directory position).

    prefix_counts: entries by the leading max_depth bits of the key. A bucket of max_depth is not
    split further; what exceeds its capacity is chained."""
    sums = np.append(0, np.cumsum(prefix_counts))
    depth, todo, final = 0, [(0, 0)], []
    while todo:
        prefix, local = todo.pop()
        lo, hi = prefix << (max_depth - local), (prefix + 1) << (max_depth - local)
        if sums[hi] - sums[lo] > capacity and local < max_depth:
            depth = max(depth, local + 1)  # beyond the directory's depth: it doubles
            todo += [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)]
        else:
            final.append((prefix, local))
    bucket, local_depth = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth, dtype=np.int64)
    for i, (prefix, local) in enumerate(sorted(final, key=lambda b: b[0] << (max_depth - b[1]))):
        at = slice(prefix << (depth - local), (prefix + 1) << (depth - local))
        bucket[at], local_depth[at] = i, local
    return depth, bucket, local_depth


def _key(text: str = "text"):
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def _prefix(key, bits: int):
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def _combine(keys: DataFrame) -> DataFrame:
    """(key, n) with the equal keys of a batch as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return keys.mapInArrow(run, "key bigint, n bigint")


def _chain(owned: DataFrame) -> DataFrame:
    """Owners add up the runs of equal keys of owned(key, n, bucket), which comes sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # the run that the next batch may go on with

        def out(key: list, n: list, bucket: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (key, n, bucket)], names=["key", "n", "bucket"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, bucket = (batch.column(k).to_numpy() for k in range(3))
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n, bucket = key[at], np.add.reduceat(n, at), bucket[at]
            if last and last[0] == key[0]:
                n[0] += last[1]
            elif last:
                yield out(*([x] for x in last))
            yield out(key[:-1], n[:-1], bucket[:-1])
            last = int(key[-1]), int(n[-1]), int(bucket[-1])
        if last:
            yield out(*([x] for x in last))

    return owned.mapInArrow(run, "key bigint, n bigint, bucket bigint")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(entries, directory), both written to shared storage: entries(key, n, bucket), n being the length of the key's chain, sorted within
    each owner's files; directory(position, bucket, local_depth)."""
    spark = docs.sparkSession
    keys = docs.select(_key().alias("key")).where("key is not null")
    total = keys.count()
    max_depth = max(1, math.ceil(math.log2(max(1, total / capacity))) + SPARE_BITS)
    found = keys.groupBy(_prefix(F.col("key"), max_depth).alias("p")).agg(F.count("*").alias("n")).toArrow()  # some eight counts a bucket
    counts = np.zeros(1 << max_depth, dtype=np.int64)
    counts[found.column("p").to_numpy()] = found.column("n").to_numpy()
    depth, bucket, local = grow_directory(counts, capacity, max_depth)
    path = scratch_path(spark, "extendible-index")
    table = pa.table({"position": pa.array(np.arange(1 << depth, dtype=np.int32)), "bucket": pa.array(bucket), "local_depth": pa.array(local)})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/directory")
    directory = spark.read.schema("position int, bucket bigint, local_depth bigint").parquet(f"{path}/directory")
    places = directory.select("position", "bucket")
    combined = _combine(keys).withColumn("position", _prefix(F.col("key"), depth))
    placed = combined.join(F.broadcast(places) if len(bucket) <= BROADCAST_POSITIONS else places, "position")
    owners = max(1, -(-total // (capacity * 16)))
    owned = placed.select("key", "n", "bucket").repartitionById(owners, F.expr(f"cast(bucket * {owners} div {int(bucket.max()) + 1} as int)"))
    _chain(owned.sortWithinPartitions("bucket", "key")).write.parquet(f"{path}/entries")
    return spark.read.schema("key bigint, n bigint, bucket bigint").parquet(f"{path}/entries"), directory


def chained_keys(entries: DataFrame) -> DataFrame:
    """Keys with more than one entry: the owners' chains."""
    return entries.where("n > 1").select("key")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _marked(docs: DataFrame, capacity: int) -> tuple[DataFrame, str, str]:
    """docs with the first doc_id of each row's link, as a struct that is null for a row of a unique key, and with the row's
    number among the rows of the link that have that doc_id, null for the others; the names of the two columns."""
    entries, _ = build_index(docs, capacity)
    key, first, nth = (fresh(docs, f"_chain_{x}") for x in ("key", "first", "nth"))
    chains = write_table(chained_keys(entries).withColumnRenamed("key", key), "chained-keys")
    keyed = docs.withColumn(key, _key())
    head = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"))).alias(first)
    links = write_table(keyed.select(key, "text", "doc_id").join(_few(chains), key, "left_semi").groupBy(key, "text").agg(head), "chain-links")
    several = links.groupBy(key).agg(F.count("*").alias("k"), F.min(first).alias(first))
    plain = write_table(several.where("k = 1").select(key, first), "chain-heads")
    colliding = _few(several.where("k > 1").select(key))
    by_text = links.join(colliding, key, "left_semi")
    found = keyed.join(colliding, key, "left_anti").join(_few(plain), key, "left").unionByName(keyed.join(colliding, key, "left_semi").join(by_text, [key, "text"]).select(*keyed.columns, first))
    # almost always one row a link has the doc_id that stays
    leads = F.col(first).isNotNull() & F.col(f"{first}.doc_id").eqNullSafe(F.col("doc_id"))
    number = F.row_number().over(W.partitionBy(key, "text").orderBy("doc_id"))
    others = found.where(~leads).withColumn(nth, F.lit(None).cast("int"))
    return others.unionByName(found.where(leads).withColumn(nth, number)), first, nth


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, keep) for each row: keep_id is the doc_id of the copy that stays."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked, first, nth = _marked(rows, capacity)
    unique = F.col(first).isNull()
    return marked.select("doc_id", F.when(unique, F.col("doc_id")).otherwise(F.col(f"{first}.doc_id")).alias("keep_id"), (unique | F.coalesce(F.col(nth) == 1, F.lit(False))).alias("keep"))


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep; all columns stay."""
    marked, first, nth = _marked(docs, capacity)
    return marked.where(F.col(first).isNull() | (F.col(nth) == 1)).select(docs.columns)


def oracle() -> str:
    return """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE first_value(doc_id) OVER w END AS keep_id, text IS NULL OR row_number() OVER w = 1 AS keep
FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)"""
