"""Finding nodes by words, and walking from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.storage import cut, discard, stored

DEPTH = 2
MAX_SEEDS = 3
PRIORITY = {4: ("document", "code_file"), 3: ("class", "function", "interface", "enum"), 2: ("method", "property", "type", "heading", "memory_fact"), 1: ("symbol", "schema_object", "schema_field"), -2: ("resource", "tag", "package")}


def type_priority() -> Column:
    out = F.when(F.lit(False), 0)
    for score, types in PRIORITY.items():
        out = out.when(F.col("type").isin(*types), score)
    return out.otherwise(0)


def score_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """nodes that a word of query occurs in, with their score; order by score, then ord."""
    terms = X.py_normalize_label(query).split()
    if not terms:
        return nodes.withColumn("score", F.lit(0).cast("bigint")).where("false")
    label, path = F.coalesce("normalized_label", X.normalize_label(F.col("label"))), F.coalesce(X.normalize_label(F.col("path")), F.lit(""))

    def points(acc: Column, t: Column) -> Column:
        on_label = F.when(acc["label"] == t, 100).when(acc["label"].startswith(t), 50).when(acc["label"].contains(t), 10).otherwise(0)
        on_path = F.when(acc["path"].startswith(t), 8).when(acc["path"].contains(t), 5).otherwise(0)
        return F.struct(acc["label"].alias("label"), acc["path"].alias("path"), (acc["score"] + on_label + on_path).cast("bigint").alias("score"))

    # label and path are normalised once, however many words the query has
    start = F.struct(label.alias("label"), path.alias("path"), F.lit(0).cast("bigint").alias("score"))
    total = F.aggregate(F.array(*map(F.lit, terms)), start, points, lambda acc: acc["score"])
    scored = nodes.withColumn("score", total).where("score > 0")
    return scored.withColumn("score", F.col("score") + type_priority()).where("score > 0")


def get_node(nodes: DataFrame, query: str) -> DataFrame:
    """The best node for query: one row or none."""
    return score_nodes(nodes, query).orderBy(F.desc("score"), "ord").limit(1)


def k_hop(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes with their hop, edges at nodes nearer than depth) around seeds(id)."""
    seen = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hop") == hop - 1)
        if frontier.isEmpty():
            break
        out = edges.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
        into = edges.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
        seen = cut(seen.unionByName(out.union(into).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))))
    inner = seen.where(F.col("hop") < depth).select("id")
    sources, targets = (inner.withColumnRenamed("id", end) for end in ("source", "target"))
    # each edge once: those that leave an inner node, then those that only lead to one
    touched = edges.join(sources, "source", "left_semi").unionByName(edges.join(targets, "target", "left_semi").join(sources, "source", "left_anti"))
    return nodes.join(seen, "id"), touched.select(*edges.columns)


def query_graph(nodes: DataFrame, edges: DataFrame, query: str, depth: int = DEPTH, max_seeds: int = MAX_SEEDS) -> tuple[DataFrame, DataFrame]:
    """The subgraph around the best max_seeds nodes for query."""
    seeds = score_nodes(nodes, query).orderBy(F.desc("score"), "ord").limit(max_seeds)
    return k_hop(nodes, edges, seeds, depth)


def neighbors(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(id, label, type, relation, direction, ...) of each edge at the best node for query; a loop is twice
    outgoing."""
    best = get_node(nodes, query).select("id").first()
    at = F.lit(best.id if best else None)
    out = F.when(F.col("source") == at, F.struct(F.lit("outgoing").alias("direction"), F.col("target").alias("_to")))
    into = F.when(F.col("target") == at, F.struct(F.when(F.col("source") == at, "outgoing").otherwise("incoming").alias("direction"), F.col("source").alias("_to")))
    # the edges are read once, and written as their number tells how to join them
    both = edges.where((F.col("source") == at) | (F.col("target") == at)).withColumn("_way", F.explode(F.array(out, into))).where("_way is not null")
    met = stored(both.withColumnRenamed("ord", "edge_ord").select("*", "_way.*").drop("_way"), "met")
    return met.join(nodes.select(F.col("id").alias("_to"), "label", "type"), "_to").withColumnRenamed("_to", "id")


def index(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Lookup tables: nodes by id, edges by either end (a loop once for each), nodes by source."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"), *[F.col(c) for c in edges.columns])
    return {"nodes_by_id": nodes, "edges_by_node_id": ends, "nodes_by_source_item_id": nodes.where("source_item_id <> ''")}


def community_nodes(nodes: DataFrame, community: int) -> DataFrame:
    return nodes.where(F.col("community") == community)


def _both(edges: DataFrame, *more: str) -> DataFrame:
    """(id, to, w, ...) of both directions of edges that are no loops."""
    ways = [F.struct(F.col(a).alias("id"), F.col(b).alias("to"), X.edge_weight(F.col("confidence_score")).alias("w"), *more) for a, b in (("source", "target"), ("target", "source"))]
    return edges.where("source <> target").select(F.inline(F.array(*ways)))


def costs(edges: DataFrame, start: DataFrame, target: str | None = None) -> DataFrame:
    """(id, cost, round) of the cheapest ways from start(id), and the round that found them: relaxation over
    the nodes that changed, ended early once nothing open is cheaper than target. Only ids and numbers go
    through the rounds, and a round's table is deleted when the next is written."""
    both = stored(_both(edges), "ways")
    best = stored(start.select("id", F.lit(0.0).alias("cost"), F.lit(0).alias("round"), F.lit(True).alias("open")).distinct(), "costs")
    step = 0
    while True:
        alive = best.where("open")
        if target is not None:
            alive = alive.crossJoin(F.broadcast(best.agg(F.min(F.when(F.col("id") == target, F.col("cost"))).alias("_bound")))).where("_bound is null or cost < _bound")  # one row
        if alive.isEmpty():
            discard(both)
            return best.select("id", "cost", "round")
        step += 1
        none = F.lit(None)
        reach = best.where("open").select("id", "cost").join(both, "id").select(F.col("to").alias("id"), none.cast("double").alias("old"), none.cast("int").alias("round"), (F.col("cost") + F.col("w")).alias("new"))
        tried = best.select("id", F.col("cost").alias("old"), "round", none.cast("double").alias("new")).unionByName(reach).groupBy("id").agg(F.min("old").alias("old"), F.min("round").alias("round"), F.min("new").alias("new"))
        better = F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull())
        after = stored(tried.select("id", F.when(better, F.col("new")).otherwise(F.col("old")).alias("cost"), F.when(better, F.lit(step)).otherwise(F.col("round")).alias("round"), better.alias("open")), "costs")
        discard(best)
        best = after


def distances(edges: DataFrame, start: DataFrame, target: str | None = None) -> DataFrame:
    """(id, cost, parent, edge) of the cheapest ways from start(id); see costs. Of several last edges the
    one that was met in the earliest round counts, then the one that came first."""
    best = costs(edges, start, target)
    ends = best.select(F.col("id").alias("to"), F.col("cost").alias("_cost"), F.col("round").alias("_round"))
    last = _both(edges, "ord", "source", "target", "relation").join(best, "id").join(ends, "to").where("cost + w = _cost and round + 1 = _round")
    way = last.groupBy("to").agg(F.min_by(F.struct(F.col("id").alias("parent"), F.struct("ord", "source", "target", "relation").alias("edge")), "ord").alias("p"))
    return best.select("id", "cost").join(way.select(F.col("to").alias("id"), "p.*"), "id", "left")


def shortest_path(nodes: DataFrame, edges: DataFrame, source_query: str, target_query: str) -> tuple[list[str], list[dict], float] | None:
    """(node ids, edges, total weight) of the cheapest way between the best nodes for two
    queries, None if there is none. What reaches the driver is the path."""
    ends = [get_node(nodes, q).select("id").first() for q in (source_query, target_query)]
    if None in ends:
        return None
    a, b = ends[0].id, ends[1].id
    if a == b:
        return [a], [], 0.0
    way = distances(edges, nodes.where(F.col("id") == a).select("id"), b)
    found = cut(way)
    ids, used, at, total = [b], [], b, None
    while at != a:
        row = found.where(F.col("id") == at).first()
        if row is None or row.parent is None:
            return None
        total = row.cost if total is None else total
        used.append({k: row.edge[k] for k in ("source", "target", "relation")})
        at = row.parent
        ids.append(at)
    return ids[::-1], used[::-1], total
