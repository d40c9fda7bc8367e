"""Timeline, snapshots and differences of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def source_hashes(nodes: DataFrame) -> DataFrame:
    """(source_item_id, hash): the last hash that a source's nodes carry."""
    return nodes.where("source_item_id <> '' and hash is not null").groupBy("source_item_id").agg(F.max_by("hash", "ord").alias("hash"))


def entries(items: DataFrame, event: Column, timestamp: str, previous_hash: Column, node_ids: Column) -> DataFrame:
    about = F.to_json(F.struct("path", "updated_at", "source_type"))
    return items.select(F.concat_ws(":", F.lit(timestamp), event, "id").alias("id"), F.lit(timestamp).alias("timestamp"), event.alias("event"), F.col("id").alias("source_item_id"), F.col("title").alias("label"), "hash", previous_hash.alias("previous_hash"), node_ids.alias("node_ids"), about.alias("metadata"))


def initial_timeline(items: DataFrame, extracted: DataFrame | None, timestamp: str) -> DataFrame:
    """An `added` entry for each item, with the ids of its nodes."""
    none = F.lit(None).cast("string")
    if extracted is None:
        return entries(items, F.lit("added"), timestamp, none, F.lit(None).cast("array<string>"))
    made = extracted.select("item_seq", F.transform("nodes", lambda n: n["id"]).alias("_ids"))
    return entries(items.join(made, "item_seq", "left"), F.lit("added"), timestamp, none, F.col("_ids"))


def update_timeline(previous_nodes: DataFrame, items: DataFrame, deleted: DataFrame, timestamp: str) -> DataFrame:
    """`updated` or `added` for each item, `removed` for each of deleted(source_item_id)."""
    known = previous_nodes.where("source_item_id <> ''").select(F.col("source_item_id").alias("_known")).distinct()
    hashes = source_hashes(previous_nodes).select(F.col("source_item_id").alias("_hashed"), F.col("hash").alias("_hash"))
    seen = items.join(known, items.id == F.col("_known"), "left").join(hashes, F.col("id") == F.col("_hashed"), "left")
    upserts = entries(seen, F.when(F.col("_known").isNotNull(), "updated").otherwise("added"), timestamp, F.col("_hash"), F.lit(None).cast("array<string>"))
    gone = deleted.join(hashes, deleted.source_item_id == F.col("_hashed"), "left")
    none = F.lit(None).cast("string")
    removed = gone.select(F.concat_ws(":", F.lit(timestamp), F.lit("removed"), "source_item_id").alias("id"), F.lit(timestamp).alias("timestamp"), F.lit("removed").alias("event"), "source_item_id", none.alias("label"), none.alias("hash"), F.col("_hash").alias("previous_hash"), F.lit(None).cast("array<string>").alias("node_ids"), none.alias("metadata"))
    return upserts.unionByName(removed)


def snapshot(nodes: DataFrame, edges: DataFrame, label: str, timestamp: str, community_count: int = 0) -> DataFrame:
    """One row: counts, and the hash of each source."""
    hashes = source_hashes(nodes).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_item_id", "hash")))).alias("source_hashes"))
    n = nodes.agg(F.count("*").alias("node_count"), F.countDistinct(F.nullif("source_item_id", F.lit(""))).alias("source_count"))
    e = edges.agg(F.count("*").alias("edge_count"))
    return n.crossJoin(e).crossJoin(hashes).select(F.lit(f"{timestamp}:{label}").alias("id"), F.lit(timestamp).alias("timestamp"), F.lit(label).alias("label"), "node_count", "edge_count", "source_count", F.lit(community_count).cast("bigint").alias("community_count"), "source_hashes")


def diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(kind, key): added_node, removed_node, changed_node, added_edge, removed_edge, changed_source."""

    def content(df: DataFrame) -> Column:
        # places in the order are no content
        return F.to_json(F.struct(*sorted(c for c in df.columns if c != "ord")))

    old = old_nodes.select(F.col("id").alias("old_id"), content(old_nodes).alias("old_body"), F.col("source_item_id").alias("old_item"))
    new = new_nodes.select(F.col("id").alias("new_id"), content(new_nodes).alias("new_body"), F.col("source_item_id").alias("new_item"))
    both = old.join(new, F.col("old_id") == F.col("new_id"), "full_outer")
    kind = F.when(F.col("old_id").isNull(), "added_node").when(F.col("new_id").isNull(), "removed_node").when(F.col("old_body") != F.col("new_body"), "changed_node")
    # a changed node gives its own row and one for its source, from one pass over the join
    rows = both.withColumn("kind", kind).where("kind is not null").select(F.inline(F.array(F.struct("kind", F.coalesce("new_id", "old_id").alias("key")), F.struct(F.lit("changed_source").alias("kind"), F.nullif(F.coalesce("new_item", "old_item"), F.lit("")).alias("key"))))).where("key is not null").distinct()
    keys = [e.select(X.edge_key("context").alias("key"), F.lit(side).alias("side")) for side, e in ((1, old_edges), (2, new_edges))]
    edge = keys[0].unionByName(keys[1]).groupBy("key").agg(F.min("side").alias("first"), F.max("side").alias("last")).where("first = last")
    return rows.unionByName(edge.select(F.when(F.col("last") == 2, "added_edge").otherwise("removed_edge").alias("kind"), "key"))


SUMMARY = {"added_node": "added_node_count", "removed_node": "removed_node_count", "changed_node": "changed_node_count", "added_edge": "added_edge_count", "removed_edge": "removed_edge_count", "changed_source": "changed_source_count"}


def summary(changes: DataFrame) -> DataFrame:
    """One row of six counts."""
    return changes.agg(*[F.coalesce(F.sum((F.col("kind") == k).cast("bigint")), F.lit(0)).alias(v) for k, v in SUMMARY.items()])
