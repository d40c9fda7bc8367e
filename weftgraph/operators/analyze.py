"""Graph analytics over node and edge tables. Traversal is undirected, PageRank directed."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.storage import discard, numbered, stored
from ..schema import CONFIDENCE, SIDE_TYPES

TOP_N = 10
SURPRISING = 5
BETWEENNESS_NODES = 500
DAMPING = 0.85
ITERATIONS = 30
#: PageRank of up to this many edges runs in one task (16 bytes an edge); more are a loop of joins.
ONE_TASK_EDGES = 2_000_000
#: Links whose components a task finds at once, and those that one task joins at the end (16 bytes each).
CHUNK = 1 << 20
ONE_TASK_LINKS = 2_000_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour) of both directions, in one pass; a loop counts twice."""
    return edges.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour")), F.struct(F.col("target").alias("id"), F.col("source").alias("neighbour")))))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, id, label, type, degree) of every node."""
    count = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return stored(nodes.select("ord", "id", "label", "type").join(count, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint")), "degrees")


def _main(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("type", F.lit("")).isin(*SIDE_TYPES))


def god_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The top_n nodes of the highest degree, those that came first before their equals."""
    return _main(degrees(nodes, edges)).orderBy(F.desc("degree"), "ord").limit(top_n).select("id", "label", "degree")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _main(degrees(nodes, edges)).where("degree <= 1").select("id", "label", "degree")


def confidence_breakdown(edges: DataFrame) -> DataFrame:
    """(confidence, n) for all levels, those without edges too."""
    one = edges.agg(*[F.coalesce(F.sum((F.col("confidence") == c).cast("bigint")), F.lit(0)).alias(c) for c in CONFIDENCE])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("confidence"), F.col(c).alias("n")) for c in CONFIDENCE])))


def surprise(confidence: str = "confidence", relation: str = "relation"):
    base = F.when(F.col(confidence) == "AMBIGUOUS", 3).when(F.col(confidence) == "INFERRED", 2).otherwise(1)
    return base + F.when(F.col(relation) == "references", 1).otherwise(0)


def surprising_connections(nodes: DataFrame, edges: DataFrame, top_n: int = SURPRISING) -> DataFrame:
    """(rank, source, target, relation, confidence, reason) of edges between different sources."""

    def end(name: str) -> DataFrame:
        return nodes.where("source_item_id <> ''").select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"), F.col("source_item_id").alias(f"{name}_item"))

    cross = edges.select("ord", "source", "target", "relation", "confidence").join(end("source"), "source").join(end("target"), "target").where("source_item <> target_item")
    top = cross.withColumn("score", surprise()).orderBy(F.desc("score"), "ord").limit(top_n)
    reason = F.when(F.col("confidence") == "INFERRED", "Cross-source inferred reference").otherwise("Cross-source structural connection")
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ord")))  # top_n rows
    return ranked.select("rank", F.col("source_label").alias("source"), F.col("target_label").alias("target"), "relation", "confidence", reason.alias("reason"))


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices of the links a to b, the smallest vertex of the component of each)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, w, top = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(u):
        np.minimum.at(top, np.maximum(u, w), np.minimum(u, w))
        while not np.array_equal(up := top[top], top):
            top = up
        u, w = top[u], top[w]
        apart = u != w
        u, w = u[apart], w[apart]
    return ids, ids[top]


def _stars(links: DataFrame, chunk: int | None = None) -> DataFrame:
    """(id, root) of the components of each `chunk` rows of links(a, b); None takes a partition as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))], names=["id", "root"])

        held, n = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if chunk and n >= chunk:
                yield star()
                held, n = [], 0
        if n:
            yield star()

    return links.mapInArrow(run, "id bigint, root bigint")


def joined(links: DataFrame, chunk: int = CHUNK, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, root) of the vertices of links(a, b), numbers: root is one vertex of the component. Chunks of links
    become stars first. A vertex of several stars joins their roots, and these are all that is left to join."""
    stars = _stars(links, chunk).groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots"))  # at most one root a chunk
    met = stored(stars, "stars")
    more = F.slice("roots", F.lit(2), F.size("roots"))
    rest = stored(met.where("size(roots) > 1").select(F.col("roots")[0].alias("a"), F.explode(more).alias("b")).distinct(), "links")
    n = rest.count()
    label = met.select("id", F.col("roots")[0].alias("root"))
    if n <= one_task:
        tops = stored(_stars(rest.coalesce(1)), "tops")
    else:  # hooking halves the vertices where stars hardly help
        tops = joined(rest, chunk, one_task) if 2 * n <= met.count() else _hooked(rest, chunk, one_task)
    found = stored(_renamed(label, tops), "labels")
    discard(met, rest, tops)
    return found


def _renamed(label: DataFrame, tops: DataFrame) -> DataFrame:
    """label(id, root) with the root that tops gives to a root."""
    return label.join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def _hooked(links: DataFrame, chunk: int, one_task: int) -> DataFrame:
    """joined(), where every vertex is hooked to its smallest neighbour, these are followed to their ends, and the
    graph of the ends, which has at most half of the vertices, is joined."""
    near = links.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near"))))).groupBy("id").agg(F.min("near").alias("near"))
    label = stored(near.select("id", F.least("id", "near").alias("root")), "labels")
    while True:
        tops = label.select(F.col("id").alias("root"), F.col("root").alias("top"))
        moved = stored(label.join(tops, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "labels")
        discard(label)
        label = moved
        if moved.where("moved").isEmpty():
            break
    label_ = label.select("id", "root")
    ends = links.join(label_.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(label_.select(F.col("id").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
    rest = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    tops = joined(rest, chunk, one_task)
    found = stored(_renamed(label_, tops), "labels")
    discard(label, rest, tops)
    return found


def key_of(nodes: DataFrame) -> Callable[[Column], Column]:
    """A number for ids, as an expression: a hash under which no two ids of nodes are equal."""
    salt = 0
    while True:
        both = nodes.select(F.xxhash64(F.lit(salt), "id").alias("k"), F.xxhash64("id", F.lit(salt)).alias("other"))
        if both.groupBy("k").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").isEmpty():
            return lambda c: F.xxhash64(F.lit(salt), c)
        salt += 1


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id of each root in a batch."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("root").aggregate([("id", "min")])
        yield from t.select(["root", "id_min"]).rename_columns(["root", "id"]).to_batches()


def components(nodes: DataFrame, edges: DataFrame, chunk: int = CHUNK, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, root): root is the smallest id of the component. Edges go in as pairs of hashes of their ends, which
    are nodes, and leave their tasks as stars."""
    key = key_of(nodes)
    found = joined(edges.where("source <> target").select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b")), chunk, one_task)
    members = stored(nodes.select("id", key(F.col("id")).alias("k")).join(found.withColumnRenamed("id", "k"), "k", "left").select("id", F.coalesce("root", "k").alias("root")), "members")
    discard(found)
    names = members.mapInArrow(_smallest, "root bigint, id string").groupBy("root").agg(F.min("id").alias("name"))
    return members.join(names, "root").select("id", F.col("name").alias("root"))


def community_members(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(id, community), summary(community, label, size)), numbered from the largest. The
    label is that of the first member that is no tag or resource."""
    root = stored(components(nodes, edges), "roots")
    main = ~F.coalesce("type", F.lit("")).isin(*SIDE_TYPES)
    label = F.min_by(F.when(main, F.col("label")), F.when(main, F.col("ord")))
    found = nodes.select("ord", "id", "label", "type").join(root, "id").groupBy("root").agg(F.count("*").alias("size"), F.min("ord").alias("first"), F.coalesce(label, F.lit("Community")).alias("label"))
    groups = numbered(found, F.desc("size"), "first", name="community").withColumn("community", F.col("community").cast("int"))
    return root.join(groups.select("root", "community"), "root").select("id", "community"), groups.select("community", "label", "size")


def with_node_ids(summary: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """summary with the ids of each community in the order of nodes, as one array: for graphs whose
    largest component fits in a row."""
    ids = nodes.select("ord", "id").join(members, "id").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("node_ids"))
    return summary.join(ids, "community").select("community", "label", "size", "node_ids")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, label, size, node_ids), largest first."""
    members, summary = community_members(nodes, edges)
    return with_node_ids(summary, nodes, members)


def assign_communities(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """nodes with the community of each, by members(id, community)."""
    return nodes.join(members.select("id", F.col("community").alias("_c")), "id", "left").withColumn("community", F.col("_c")).select(*nodes.columns)


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, rank) after a fixed number of steps. Parallel edges count each; the mass of nodes
    without outgoing edges is lost."""
    # parallel edges of a pair are one row with a weight
    pairs = stored(edges.groupBy("source", "target").agg(F.count("*").alias("k")), "pairs")
    n, m = nodes.count(), pairs.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    if max(n, m) <= one_task_edges:
        rows = nodes.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("bigint").alias("k")).unionByName(pairs.select(F.col("source").alias("a"), F.col("target").alias("b"), "k"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches))
            alone = np.asarray(t.column("b").is_null())
            a = t.column("a").combine_chunks()
            ids = a.filter(pa.array(alone))
            at = np.asarray(pa.compute.index_in(a.filter(pa.array(~alone)), ids).to_numpy(zero_copy_only=False))
            to = np.asarray(pa.compute.index_in(t.column("b").combine_chunks().filter(pa.array(~alone)), ids).to_numpy(zero_copy_only=False))
            w = t.column("k").to_numpy()[~alone].astype(float)
            ok = ~(np.isnan(at.astype(float)) | np.isnan(to.astype(float)))
            at, to, w = at[ok].astype(int), to[ok].astype(int), w[ok]
            out = np.bincount(at, weights=w, minlength=len(ids))
            share = w / out[at]
            rank = np.full(len(ids), 1.0 / len(ids))
            for _ in range(iterations):
                rank = (1 - damping) / len(ids) + damping * np.bincount(to, weights=rank[at] * share, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rank)], names=["id", "rank"])

        return rows.coalesce(1).mapInArrow(run, "id string, rank double")
    ids = nodes.select("id")
    out = pairs.groupBy("source").agg(F.sum("k").alias("out"))
    live = pairs.join(out, "source").select("source", "target", (F.col("k") / F.col("out") * damping).alias("share"))
    live = stored(live.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"), "live")
    discard(pairs)
    # fixed: what a node gets from sources that move no more; moves: whether others send to it still. An edge goes when its
    # source has settled and what it sends is fixed, so a graph without cycles takes few full rounds
    state = stored(ids.select("id", F.lit((1 - damping) / n).alias("fixed"), F.lit(1.0 / n).alias("rank"), F.lit(True).alias("moves")), "ranks")
    moving = n
    for _ in range(iterations):
        sent = live.join(state.select(F.col("id").alias("source"), "rank", "moves"), "source").select(F.col("target").alias("id"), (F.col("rank") * F.col("share")).alias("x"), "moves")
        # the fixed part of each node takes part in the same aggregation, so no outer join is needed
        parts = state.select("id", F.col("fixed").alias("x"), F.lit(False).alias("moves")).unionByName(sent)
        after = stored(parts.groupBy("id").agg(F.sum(F.when(F.col("moves"), 0.0).otherwise(F.col("x"))).alias("fixed"), F.sum("x").alias("rank"), F.max("moves").alias("moves")), "ranks")
        left = state.where("moves").count()
        if left < moving:
            rest = stored(live.join(state.where("moves").select(F.col("id").alias("source")), "source", "left_semi"), "live")
            discard(live)
            live, moving = rest, left
        discard(state)
        state = after
        if not left:
            break
    discard(live)
    return state.select("id", "rank")


def betweenness(nodes: DataFrame, edges: DataFrame, limit: int = BETWEENNESS_NODES) -> DataFrame | None:
    """(id, betweenness) by Brandes' algorithm, None above `limit` nodes. Parallel edges
    multiply paths; the sum runs over ordered pairs and is scaled by 2 / ((n - 1)(n - 2))."""
    rows = nodes.select("ord", "id").orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    ids = [r.id for r in rows]
    at = {x: i for i, x in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for e in edges.where("source <> target").groupBy("source", "target").count().collect():  # few: at most limit ** 2
        if e.source in at and e.target in at:
            near[at[e.source]] += [at[e.target]] * e["count"]
            near[at[e.target]] += [at[e.source]] * e["count"]
    n = len(ids)
    scale = 2 / (n * n - 3 * n + 2) if n > 2 else 1.0

    def brandes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                dist, paths, order, before = [-1] * n, [0.0] * n, [], [[] for _ in range(n)]
                dist[s], paths[s], queue = 0, 1.0, deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in near[v]:
                        if dist[w] < 0:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                delta = [0.0] * n
                for w in reversed(order):
                    for v in before[w]:
                        delta[v] += paths[v] / paths[w] * (1 + delta[w])
                    if w != s:
                        total[w] += delta[w]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["i", "b"])

    spark = nodes.sparkSession
    sums = spark.range(n).select("id").mapInArrow(brandes, "i bigint, b double").groupBy("i").agg((F.sum("b") * scale).alias("betweenness"))
    names = spark.createDataFrame(list(enumerate(ids)), "i bigint, id string")
    return names.join(sums, "i", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def articulation_points(order: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """Cut vertices by an iterative depth-first search; parallel edges to the parent don't count."""
    near: dict[str, list[str]] = {x: [] for x in order}
    for a, b in pairs:
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    found: dict[str, None] = {}
    for root in order:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        children, stack = 0, [(root, None, iter(near[root]))]
        while stack:
            u, parent, rest = stack[-1]
            for v in rest:
                if v not in seen:
                    seen[v] = low[v] = len(seen)
                    stack.append((v, u, iter(near[v])))
                    break
                if v != parent:
                    low[u] = min(low[u], seen[v])
            else:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[u])
                if parent == root:
                    children += 1
                    if children > 1:
                        found[root] = None
                elif low[u] >= seen[parent]:
                    found[parent] = None
    return list(found)


def _blocks(n: int, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, block of each) of the blocks, the parts that no vertex of theirs cuts, of the vertices below n and the
    links u to w. A vertex of several blocks cuts. Depth first without recursion; the graph is numbers of 4 bytes."""
    ends = np.concatenate([u, w]).astype(np.int32)
    order = np.argsort(ends, kind="stable")
    near = memoryview(np.concatenate([w, u]).astype(np.int32)[order])
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    at, end = memoryview(first[:-1].copy()), memoryview(first[1:].copy())
    num, low = memoryview(np.zeros(n, np.int32)), memoryview(np.zeros(n, np.int32))
    found, starts, time = array("i"), array("i"), 0
    for root in range(n):
        if num[root]:
            continue
        time += 1
        num[root] = low[root] = time
        path, seen = [root], []
        while path:
            x = path[-1]
            k = at[x]
            if k < end[x]:
                at[x] = k + 1
                y = near[k]
                t = num[y]
                if not t:
                    time += 1
                    num[y] = low[y] = time
                    path.append(y)
                    seen.append(y)
                elif t < low[x]:
                    low[x] = t
                continue
            path.pop()
            if not path:
                continue
            up, reach = path[-1], low[x]
            if reach >= num[up]:
                starts.append(len(found))
                found.append(up)
                y = -1
                while y != x:
                    y = seen.pop()
                    found.append(y)
            elif reach < low[up]:
                low[up] = reach
    sizes = np.diff(np.append(np.array(starts, np.int64), len(found)))
    return np.array(found, np.int64), np.repeat(np.arange(len(starts)), sizes)


def _contracted(a: np.ndarray, b: np.ndarray, tails: np.ndarray, known: np.ndarray, homed: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """(cut vertices, a, b, tails) of a smaller graph with the same further cut vertices, from the links a to b of one
    group. Vertices that are homed here have all their links here, unless they are among `known`, who have others
    elsewhere; the links of those that are homed elsewhere may be anywhere. tails names vertices that something
    hangs on which leads nowhere else.

    A block becomes a cycle of those of its vertices that other links can meet, in their order; a block with one of these
    hangs on it, and goes."""
    m = len(a)
    ids, at = np.unique(np.concatenate([a, b, tails, known]), return_inverse=True)
    n, u, w = len(ids), at[:m], at[m : 2 * m]
    proven = np.zeros(n, bool)
    proven[at[2 * m + len(tails) :]] = True
    outside = proven | ~homed(ids)
    members, block = _blocks(n, u, w)
    n_blocks = int(block[-1]) + 1 if len(block) else 0
    count = np.bincount(members, minlength=n)
    meets = outside | (count > 1)
    size = np.bincount(block[meets[members]], minlength=n_blocks)
    weak = np.flatnonzero(size < 2).tolist()
    hanging = np.bincount(at[2 * m : 2 * m + len(tails)], minlength=n)
    gone = np.zeros(n_blocks, bool)
    if weak:
        # sums tell the last vertex of a block and the last block of a vertex
        held = meets[members]
        last = memoryview(np.bincount(block[held], weights=members[held], minlength=n_blocks).astype(np.int64))
        blocks = memoryview(np.bincount(members, weights=block, minlength=n).astype(np.int64))
        while weak:
            k = weak.pop()
            if gone[k]:
                continue
            gone[k] = True
            if not size[k]:
                continue
            v = last[k]
            count[v] -= 1
            blocks[v] -= k
            hanging[v] += 1
            if count[v] == 1 and not outside[v]:
                other = blocks[v]
                size[other] -= 1
                last[other] -= v
                meets[v] = False
                if size[other] < 2:
                    weak.append(other)
    cuts = (hanging > 0) & ((hanging + count > 1) | proven)
    left = meets[members] & ~gone[block]
    v, k = members[left], block[left]
    order = np.lexsort((v, k))
    v, k = v[order], k[order]
    begins = np.flatnonzero(np.diff(k, prepend=-1))
    sizes = np.diff(np.append(begins, len(v)))
    after = np.arange(1, len(v) + 1)
    after[begins + sizes - 1] = begins
    x, y = v, v[after]
    two = np.repeat(sizes, sizes) == 2
    x, y, one = x[~two], y[~two], begins[sizes == 2]
    # a pair keeps the direction of its link, where it is one
    low, high = v[one], v[one + 1]
    codes, first = np.unique(np.minimum(u, w) * n + np.maximum(u, w), return_index=True)
    if len(one) and len(codes):
        code = low * n + high
        where = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        same = codes[where] == code
        low, high = np.where(same, u[first[where]], low), np.where(same, w[first[where]], high)
    return ids[cuts], ids[np.concatenate([x, low])], ids[np.concatenate([y, high])], ids[outside & (hanging > 0) & ~cuts]


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    """The group of each hash, one of `parts` ranges."""
    return (((ids >> 32) + (1 << 31)) * parts) >> 32


def _rows(cut: np.ndarray, a: np.ndarray, b: np.ndarray, tails: np.ndarray) -> pa.Table:
    """Rows (a, b, cut): links, tails without b, and cut vertices without b."""
    none = pa.nulls(len(cut) + len(tails), pa.int64())
    return pa.table({"a": np.concatenate([a, tails, cut]), "b": pa.chunked_array([pa.array(b, pa.int64()), none]), "cut": np.repeat([False, True], [len(a) + len(tails), len(cut)])})


def _in_chunks(chunk: int, run: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over the rows of a task, `chunk` at once."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from run(pa.Table.from_batches(held)).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from run(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return go


def cut_vertices(links: DataFrame, chunk: int = CHUNK, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id) of the cut vertices of links(a, b), numbers that are spread evenly.

    Chunks of links are contracted where they lie, then groups: a link goes to the group of that end which has fewer
    links in its chunk, so that most vertices have all their links in one group and go. Cycles run in the order of the
    groups, so few of their links leave one. Groups grow where this helps little; the last round is one group."""

    def alone(t: pa.Table) -> pa.Table:
        a, b = (t.column(k).to_numpy() for k in (0, 1))
        none = np.zeros(0, np.int64)
        return _rows(*_contracted(a, b, none, none, lambda ids: np.zeros(len(ids), bool)))

    def routed(parts: int, swap: bool) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            tail = np.asarray(t.column("b").is_null())
            a, b = t.column("a").to_numpy(), t.column("b").filter(pa.array(~tail)).to_numpy()
            tails, a = a[tail], a[~tail]
            _, at, n = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
            few = n[at]
            other = few[: len(a)] >= few[len(a) :] if swap else few[: len(a)] > few[len(a) :]
            a, b = np.where(other, b, a), np.where(other, a, b)
            far = np.unique(b[_home(a, parts) != _home(b, parts)])
            owner = np.concatenate([a, tails, far])
            none = pa.nulls(len(tails) + len(far), pa.int64())
            return pa.table({"p": _home(owner, parts), "a": owner, "b": pa.chunked_array([pa.array(b, pa.int64()), none]), "known": np.repeat([False, True], [len(a) + len(tails), len(far)])})

        return run

    def grouped(parts: int) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            p, known, link = t.column("p")[0].as_py(), np.asarray(t.column("known")), np.asarray(t.column("b").is_valid())
            a, b = t.column("a").to_numpy(), t.column("b").filter(pa.array(link)).to_numpy()
            return _rows(*_contracted(a[link], b, a[~link & ~known], a[known], lambda ids: _home(ids, parts) == p))

        return run

    rows = "a bigint, b bigint, cut boolean"
    state = stored(links.select("a", "b").mapInArrow(_in_chunks(chunk, alone), rows), "links")
    found, n, size, swap = [], state.count(), chunk, False
    while n:
        parts = 1 if n <= one_task else -(-n // size)
        sent = state.where("not cut").select("a", "b").mapInArrow(_in_chunks(chunk, routed(parts, swap)), "p bigint, a bigint, b bigint, known boolean")
        after = stored(sent.groupBy("p").applyInArrow(grouped(parts), rows), "links")
        found.append(stored(after.where("cut").select(F.col("a").alias("id")), "cuts"))
        left = after.where("not cut").count()
        discard(state)
        # a round and its swapped one each get a chance before groups grow
        state, size, n, swap = after, size * 2 if swap and 4 * left > 3 * n else size, left, not swap
    discard(state)
    ids = found[0] if found else links.select(F.col("a").alias("id")).where("false")
    for x in found[1:]:
        ids = ids.unionByName(x)
    return ids.distinct()


def bridge_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, degree) of cut vertices. Edges, whose ends are nodes, go in as pairs of hashes."""
    key = key_of(nodes)
    links = stored(edges.select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b")), "links")
    cuts = stored(cut_vertices(links).withColumnRenamed("id", "k"), "cuts")
    degree = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("degree"))
    found = stored(nodes.select("id", "label", key(F.col("id")).alias("k")).join(cuts, "k").join(degree, "k").select("id", "label", "degree"), "bridges")
    discard(links, cuts)
    return found
