"""Building, checking and changing graphs: all joins and windows over node and edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..plans.storage import stored
from ..schema import EDGE_COLUMNS, NODE_COLUMNS

#: Added to the epoch of what moves behind all else.
BEHIND = 1 << 20
#: Rows of repeated keys are told from others by a broadcast of hashes, of at most this many.
FEW_KEYS = 2_000_000
#: Edges whose ends are made unique at once.
CHUNK = 1 << 20
#: Ranges of hashes that are shuffled together.
RANGES = 4096
#: Relations of new edges that old ones are asked for by name.
FEW_RELATIONS = 100
MERGEABLE = ("class", "enum", "function", "interface", "method", "symbol", "type")


def ord_of(item: Column, pos: Column, epoch: int = 0, sub: int = 0) -> Column:
    return F.struct(F.lit(epoch).alias("epoch"), item.cast("bigint").alias("item"), pos.cast("bigint").alias("pos"), F.lit(sub).alias("sub"))


def complete(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """df with all of columns, those it lacks as nulls."""
    kinds = {"merged_from": "array<string>", "community": "int", "confidence_score": "double", "storage_ref": "struct<provider:string,namespace:string,physical_id:string,logical_path:string,revision:string,permission_key:string>"} | (types or {})
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns])


def raw_tables(extracted: DataFrame, epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables, in order, from one row an item with arrays of nodes and edges."""
    nodes = extracted.select("item_seq", F.posexplode("nodes").alias("pos", "n")).select(ord_of(F.col("item_seq"), F.col("pos"), epoch).alias("ord"), "n.*")
    edges = extracted.select("item_seq", F.posexplode("edges").alias("pos", "e")).select(ord_of(F.col("item_seq"), F.col("pos"), epoch).alias("ord"), "e.*")
    return nodes, edges


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers that a partition's runs have more than once, each once; 8 bytes a row meet in a task."""
    parts = [np.frombuffer(run, np.int64) for batch in batches for run in batch.column(1).to_pylist()]
    if parts:
        known, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(known[n > 1])], names=["_hash"])


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers, each at most twice in CHUNK rows: one that all rows share need not meet in a task."""

    def few() -> pa.RecordBatch:
        known, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(known, np.minimum(n, 2)))], names=["_hash"])

    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield few()
            held, rows = [], 0
    if rows:
        yield few()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_range, _run): the numbers of _twice() by range of their value, in one row for each range and CHUNK rows, as a row
    for each number costs far more to shuffle. Hashes fill all ranges alike."""
    starts = -(1 << 63) + np.arange(RANGES, dtype=np.int64) * ((1 << 63) // (RANGES // 2))
    for batch in _twice(batches):
        numbers = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))  # in order
        at = np.append(np.searchsorted(numbers, starts), len(numbers)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), RANGES, [None, pa.py_buffer(at * np.int32(8)), pa.py_buffer(numbers)])
        some = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), runs.take(pa.array(some))], names=["_range", "_run"])


def by_repetition(df: DataFrame, *key: Column | str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key no other row has, all other rows). Only hashes of keys are shuffled: rows that share
    a hash but no key are among the others, where keys themselves are compared."""
    hashed = df.withColumn("_hash", F.xxhash64(*key))
    often = stored(hashed.select("_hash").mapInArrow(_runs, "_range int, _run binary").repartition("_range").mapInArrow(_repeated, "_hash bigint"), "repeated")
    n = often.count()
    if not n or n > FEW_KEYS:
        none = df.where("false")
        return (none, df) if n else (df, none)
    often = F.broadcast(often)
    return tuple(hashed.join(often, "_hash", how).select(*df.columns) for how in ("left_anti", "left_semi"))


def _by_key(df: DataFrame, *key: Column | str, **kept: Column) -> DataFrame:
    """The aggregates `kept` of each key. Whole rows as aggregates are sorted by key first, all that a task has, unless one
    of them is an object; then few keys, however many rows they have, are hashed. The list of nothing is that object."""
    found = df.groupBy(*key).agg(*[c.alias(name) for name, c in kept.items()], F.collect_list(F.lit(None).cast("int")).alias("_none"))
    return found.where(F.size("_none") == 0).drop("_none")


def _last_nodes(nodes: DataFrame) -> DataFrame:
    rest = [c for c in nodes.columns if c not in ("ord", "id")]
    return _by_key(nodes, "id", ord=F.min("ord"), p=F.max_by(F.struct(*rest), "ord")).select("ord", "id", "p.*")


def _first_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("source", "target", "relation")]
    first = _by_key(edges, "source", "target", "relation", _item().alias("_item"), p=F.min_by(F.struct(*rest), "ord"))
    return first.select("source", "target", "relation", "p.*").select(*edges.columns)


def _few(df: DataFrame) -> DataFrame:
    """df, which is stored, to be broadcast if it has few rows, whatever size is taken for it."""
    return F.broadcast(df) if df.count() <= FEW_KEYS else df


def _item() -> Column:
    return F.coalesce("source_item_id", F.lit(""))


def _added(old: DataFrame, new: DataFrame, merge: Callable[[DataFrame], DataFrame], *key: Column | str, part: str | None = None) -> DataFrame | None:
    """merge() of old, in which no key is repeated, and new rows: only keys of new rows can be, so the others are held
    against these, and old is not read before the result is. None if new rows are too many for that. part: a column of the
    key with few values; old rows with other values than new ones have are not hashed."""
    new = stored(new, "new")
    keys = stored(new.select(F.xxhash64(*key).alias("_hash")).distinct(), "keys")
    n = keys.count()
    if n > FEW_KEYS:
        return None
    if not n:
        return old
    keys, hash_, may = F.broadcast(keys), F.xxhash64(*key), F.lit(True)
    values = [r[0] for r in new.select(part).distinct().limit(FEW_RELATIONS + 1).collect()] if part else [None]
    if None not in values and len(values) <= FEW_RELATIONS:
        may = F.col(part).isin(*values)
        hash_ = F.when(may, hash_)
    kept, met = (x.withColumn("_hash", hash_).join(keys, "_hash", how).select(*old.columns) for x, how in ((old, "left_anti"), (old.where(may), "left_semi")))
    return kept.unionByName(merge(met.unionByName(new)).select(*old.columns))


def add_edges(edges: DataFrame, new: DataFrame, sound: bool = False) -> DataFrame:
    """dedupe_edges() of both; sound: no key is repeated in edges."""
    found = _added(edges, new, _first_edges, "source", "target", "relation", _item(), part="relation") if sound else None
    return dedupe_edges(edges.unionByName(new)) if found is None else found


def dedupe_nodes(nodes: DataFrame, written: bool = True) -> DataFrame:
    """One row an id: the payload that came last at the place of the first. written: see build()."""
    rest = [c for c in nodes.columns if c not in ("ord", "id")]
    once, more = by_repetition(nodes, "id")
    last = _last_nodes(more)
    return once.select("ord", "id", *rest).unionByName(last if written else stored(last, "repeated_nodes"))


def dedupe_edges(edges: DataFrame, written: bool = True) -> DataFrame:
    """The first edge of each source, target, relation and source item. written: see build()."""
    once, more = by_repetition(edges, "source", "target", "relation", _item())
    first = _first_edges(more)
    return once.unionByName(first if written else stored(first, "repeated_edges"))


def finished_nodes(nodes: DataFrame, written: bool = True) -> DataFrame:
    return complete(dedupe_nodes(nodes, written).withColumn("normalized_label", X.normalize_label(F.col("label"))).withColumn("label", X.sanitize_label(F.col("label"))), NODE_COLUMNS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of edges, each once in CHUNK edges, whatever the size of a partition."""
    held: list[pa.Array] = []
    n = 0
    for batch in batches:
        held += [batch.column(0), batch.column(1)]
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.chunked_array(held).unique()], names=["_id"])
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.chunked_array(held).unique()], names=["_id"])


def lost_ends(edges: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """(_id) of the ends of edges that are no nodes, each once. Ids are hashed, not sorted: a task has a share of them.
    few: edges are few, so that their ends are found among the ids of nodes and these are not shuffled."""
    ends = edges.select("source", "target").mapInArrow(_ends, "_id string")
    ids = nodes.select(F.col("id").alias("_id"))
    if few:
        ends = stored(ends.distinct(), "ends")
        if ends.count() <= FEW_KEYS:
            ids = ids.join(F.broadcast(ends), "_id", "left_semi")
    return stored(ends.join(ids.hint("shuffle_hash"), "_id", "left_anti").distinct(), "lost")


def with_endpoints(edges: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """Edges whose two ends are nodes. The ends that are none, few as a rule, are found first, from ids
    alone; whole edges are then held against these."""
    return _without(edges, lost_ends(edges, nodes, few))


def _without(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """edges with no end among lost(_id)."""
    known = edges.where("source is not null and target is not null")
    if lost.isEmpty():
        return known
    lost = _few(lost)
    return known.join(lost, known.source == F.col("_id"), "left_anti").join(lost, known.target == F.col("_id"), "left_anti")


def alias_map(nodes: DataFrame, fix_extension_alias: bool = False) -> DataFrame:
    """(alias, doc_id): names that a link can use for a document; of equal ones the last wins."""
    path = X.normalize_path(F.col("path"))
    file = X.basename(path)
    bare = F.regexp_replace(path, "(?i)/index\\.[^.]+$", "")
    has = path != ""
    names = F.array(
        F.col("id"),
        F.when(has, path),
        F.when(has, X.without_extension(path, fix_extension_alias)),
        F.when(has, file),
        F.when(has, X.without_extension(file, fix_extension_alias)),
        F.when(has & (bare != path), bare),
        F.when(F.col("source_url") != "", F.col("source_url")),
    )
    named = nodes.where("type = 'document'").select("id", "ord", F.posexplode(names).alias("k", "name")).where("name is not null")
    return named.groupBy(X.normalize_alias(F.col("name")).alias("alias")).agg(F.max_by("id", F.struct("ord", "k")).alias("doc_id"))


def inferred_references(edges: DataFrame, nodes: DataFrame, fix_extension_alias: bool = False) -> DataFrame:
    """A reference for each link or import whose target names a document."""
    hrefs = nodes.where("href is not null").select(F.col("id").alias("target"), X.normalize_alias(F.col("href")).alias("alias"))
    links = edges.where(F.col("relation").isin("links_to", "imports")).join(hrefs, "target").join(alias_map(nodes, fix_extension_alias), "alias").where("doc_id <> source")
    return links.select(
        F.struct("ord.epoch", "ord.item", "ord.pos", (F.col("ord.sub") + 1).alias("sub")).alias("ord"), "source", F.col("doc_id").alias("target"), F.lit("references").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.9).alias("confidence_score"), "source_item_id", "source_location", F.lit("markdown_link").alias("context"), F.lit(None).cast("string").alias("metadata")
    )


def build(nodes: DataFrame, edges: DataFrame, fix_extension_alias: bool = False, written: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph from raw tables: labels cleaned, duplicates and dangling edges gone,
    references inferred right behind the link that gave them.

    Finished nodes and raw edges are written before they are held against each other, as several passes
    read them. No whole edge is shuffled unless its key is repeated. written=False is for raw tables that
    are files under a few expressions: only what is made of repeated keys is written, and each pass over
    the result reads the columns that it needs from the files, which costs less than all columns written once."""
    nodes, edges = finished_nodes(nodes, written), complete(edges, EDGE_COLUMNS)
    if written:
        nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    edges = with_endpoints(edges, nodes)
    if nodes.where("href is not null").isEmpty():
        return nodes, dedupe_edges(edges, written)
    new = stored(inferred_references(edges, nodes, fix_extension_alias), "references")
    return nodes, dedupe_edges(edges if new.isEmpty() else edges.unionByName(new), written)


def is_inferred_reference() -> Column:
    return (F.col("relation") == "references") & F.col("context").eqNullSafe("markdown_link") & (F.col("confidence") == "INFERRED")


def with_inferred_references(nodes: DataFrame, edges: DataFrame, fix_extension_alias: bool = False, sound: bool = False) -> DataFrame:
    """edges with their inferred references made anew, behind all others; sound: no key is repeated in edges."""
    rest = edges.where(~is_inferred_reference())
    if nodes.where("href is not null").isEmpty():
        return rest if sound else dedupe_edges(rest)
    last = rest.agg(F.max("ord.epoch").alias("last"))
    new = inferred_references(rest, nodes, fix_extension_alias).crossJoin(F.broadcast(last))  # one row
    new = new.withColumn("ord", F.struct((F.coalesce("last", F.lit(0)) + 1 + F.col("ord.epoch")).alias("epoch"), "ord.item", "ord.pos", "ord.sub")).drop("last")
    return add_edges(rest, new, sound)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, source_count."""
    n = nodes.agg(F.count("*").alias("node_count"), F.countDistinct(F.nullif("source_item_id", F.lit(""))).alias("source_count"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count"))).select("node_count", "edge_count", "source_count")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(message) for each node without id or label and each edge end that is no node. Edges are held against
    the ends that are none, few as a rule."""
    lost = lost_ends(edges, nodes)
    no_id = nodes.where("id is null or id = ''").select(F.lit("Node missing id.").alias("message"))
    no_label = nodes.where("label is null or label = ''").select(F.format_string("Node %s missing label.", F.coalesce("id", F.lit(""))).alias("message"))
    out = no_id.unionByName(no_label)
    for end in ("source", "target"):
        dangling = edges.join(lost, edges[end].eqNullSafe(F.col("_id")), "left_semi")
        out = out.unionByName(dangling.select(F.format_string(f"Edge {end} '%s' does not match any node.", end).alias("message")))
    return out


def resolve_entities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of one label and type that come from several sources become one node, the first.

    The canonical node has merged_from; edges move to it, and those that now loop or repeat go.
    Mergeable nodes come first in the order of their groups, the others follow."""
    label = F.coalesce("normalized_label", X.normalize_label(F.col("label")))
    able = nodes.where(F.col("type").isin(*MERGEABLE)).withColumn("_label", label)
    groups = able.groupBy("_label", "type").agg(
        F.min("ord").alias("first"), F.min_by("id", "ord").alias("canonical"), F.countDistinct(F.nullif("source_item_id", F.lit(""))).alias("sources"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids")
    )
    merged = groups.where("sources > 1 and n > 1")
    remap = merged.select("canonical", F.explode("ids").alias("old"))
    firsts = able.join(groups.select("_label", "type", "first"), ["_label", "type"])
    placed = firsts.join(merged.select(F.col("canonical").alias("id"), "ids"), "id", "left").join(remap.where("canonical <> old").select(F.col("old").alias("id")), "id", "left_anti")
    by_group = W.partitionBy("_label", "type").orderBy("ord")
    grouped = placed.withColumn("merged_from", F.coalesce("ids", "merged_from")).withColumn("_sub", F.row_number().over(by_group))
    grouped = grouped.withColumn("ord", F.struct("first.epoch", "first.item", "first.pos", F.col("_sub").alias("sub"))).select(*nodes.columns)
    rest = nodes.where(~F.col("type").isin(*MERGEABLE) | F.col("type").isNull()).withColumn("ord", F.struct((F.col("ord.epoch") + BEHIND).alias("epoch"), "ord.item", "ord.pos", "ord.sub"))
    out = grouped.unionByName(rest)
    to = remap.select(F.col("old").alias("_old"), F.col("canonical").alias("_to"))
    moved = edges.join(to, edges.source == F.col("_old"), "left").withColumn("source", F.coalesce("_to", "source")).drop("_old", "_to")
    moved = moved.join(to, moved.target == F.col("_old"), "left").withColumn("target", F.coalesce("_to", "target")).drop("_old", "_to")
    return out, dedupe_edges(moved.where("source <> target"))


def override_nodes(old: DataFrame, new: DataFrame, sound: bool = False) -> DataFrame:
    """old and new by id: new payloads win but keep the place of the old. sound: no id is repeated in old."""
    old, new = complete(old, NODE_COLUMNS), complete(new, NODE_COLUMNS)
    found = _added(old, new, _last_nodes, "id") if sound else None
    return complete(dedupe_nodes(old.unionByName(new)) if found is None else found, NODE_COLUMNS)


def valid_hyperedges(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hyperedges cut down to members that are nodes, if two are left; ids present, the first wins."""
    named = hyperedges.where("id is not null and id <> ''")
    named = named.groupBy("id").agg(F.min_by(F.struct("ord", "label", "nodes", "metadata"), "ord").alias("p")).select("id", "p.*")
    members = named.select("id", F.posexplode("nodes").alias("k", "node")).join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    kept = members.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("nodes")).where("size(nodes) >= 2")
    return named.drop("nodes").join(kept, "id").select("ord", "id", X.sanitize_label(F.col("label")).alias("label"), "nodes", "metadata")


def merge_fragment(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None, new_nodes: DataFrame | None, new_edges: DataFrame | None, new_hyperedges: DataFrame | None, sound: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """A graph with an enricher's nodes, edges and hyperedges. Their ord must follow the graph's. sound: the graph
    comes from build(), so nothing in it is repeated or dangling."""
    if new_nodes is not None:
        named = new_nodes.where("id is not null and id <> ''").withColumn("normalized_label", X.normalize_label(F.col("label"))).withColumn("label", X.sanitize_label(F.col("label")))
        nodes = override_nodes(nodes, named, sound)
    if new_edges is not None:
        fresh = with_endpoints(complete(new_edges, EDGE_COLUMNS), nodes).withColumn("relation", X.sanitize_label(F.col("relation")))
        edges = add_edges(edges, fresh, sound)
    if new_hyperedges is not None:
        added = valid_hyperedges(new_hyperedges, nodes)
        hyperedges = added if hyperedges is None else hyperedges.unionByName(added.join(hyperedges.select("id"), "id", "left_anti").select(*hyperedges.columns))
    return nodes, edges, hyperedges


def without_sources(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None, affected: DataFrame, sound: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What is left when all that came from the sources affected(source_item_id) goes. sound: the graph comes from
    build(), so edges lose no other ends than the nodes that go."""
    gone = _few(stored(affected.where("source_item_id <> ''").distinct(), "gone"))
    removed = nodes.join(gone, "source_item_id", "left_semi").select(F.col("id").alias("_id"))
    nodes = nodes.join(gone, "source_item_id", "left_anti").select(*nodes.columns)
    edges = edges.join(gone, "source_item_id", "left_anti").select(*edges.columns)
    edges = _without(edges, stored(removed, "lost")) if sound else with_endpoints(edges, nodes)
    if hyperedges is not None:
        lost = hyperedges.select("id", F.explode("nodes").alias("_node")).join(nodes.select(F.col("id").alias("_node")), "_node", "left_anti")
        hyperedges = hyperedges.join(lost.select("id").distinct(), "id", "left_anti").select(*hyperedges.columns)
    return nodes, edges, hyperedges


def update(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None, fragment: tuple[DataFrame, DataFrame], affected: DataFrame, fix_extension_alias: bool = False, sound: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The graph after new versions of some sources: fragment is a graph of its own, built from
    the upserted items alone with an ord that follows the old one's. sound: the graph comes from build()."""
    old, edges, hyperedges = without_sources(nodes, edges, hyperedges, affected, sound)
    nodes = override_nodes(old, fragment[0], sound)
    ids = old.select("id").unionByName(fragment[0].select("id"))
    edges = add_edges(edges, with_endpoints(fragment[1], ids, few=True), sound)
    if sound and old.where("href is not null").isEmpty() and fragment[0].where("href is not null").isEmpty():
        return nodes, edges.where(~is_inferred_reference()), hyperedges  # no payload that could win names a link
    return nodes, with_inferred_references(nodes, edges, fix_extension_alias, sound), hyperedges
