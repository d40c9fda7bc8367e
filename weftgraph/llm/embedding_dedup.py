"""Near duplicates of embeddings by iterative quantisation and multi-index Hamming tables.

1. Iterative quantisation learns, over all distinct vectors, projections to binary codes: mean and covariance
   are summed by Spark, and the principal axes are turned by rotations that alternate between fixing the
   signs and solving the orthogonal Procrustes problem. One code has at most 64 bits; as many
   rotations are learned side by side, from different starts, as the tables need bits.
2. Multi-index tables hold a substring of the codes each. A substring has as many bits as the logarithm of the
   number of vectors, so a bucket holds about one unrelated vector however many there are; the number of
   tables follows from the bits in which a pair at the threshold differs, measured after centring, so
   that such a pair shares a bucket with probability `RECALL`. Members of a bucket are tied if their
   codes differ in no more bits than `radius_of` allows.
3. What ties connect is reranked: in blocks of at most `BLOCK` vectors, larger parts cut into several that meet
   pairwise, the cosines of the original vectors decide. They are counted, not emitted.

Every vector is a query; there is no cap on partners. Equal vectors are one query, so thousands of copies
cost their number. The result has one row for each vec_id and vector: group_id is the smallest vec_id that
chains of pairs connect, n_links the number of other vectors at or over the threshold, n_equal the
number of other rows of the same vector.

Edge cases: vectors that are null, empty, zero, with null or non-finite entries, or of another
dimension than most rows have, link to nothing; rows with a null vec_id are left out; repeated rows are
one; rows of one vec_id with different vectors are a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, write_table
from .components import components

THRESHOLD = 0.95
#: Bits of one rotation
BITS = 64
ROUNDS = 10
RECALL = 0.97
BLOCK = 4096
#: Buckets of up to this many are compared by shifts, all at once
SMALL = 32
BROADCAST_ROWS = 1 << 18

def _matrices(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the usable rows of a list column, by dimension."""
    col = batch.column(column)
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], dtype=np.int64)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        flat = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(rows), d)
        with np.errstate(all="ignore"):
            size = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(size) & (size > 0)
        yield rows[ok], x[ok] / size[ok, None]


def _totals(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """{dimension: sum} of the matrices that partial(x) returns for the vectors of each task; one row of
    a matrix is one row of the table that adds them up."""

    def rows(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = sorted(total)
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in keys], type=pa.int32()), pa.array([i for _, i in keys], type=pa.int32()), pa.array([total[k] for k in keys], type=pa.list_(pa.float64()))], names=["d", "i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                part = partial(x) if len(x) else None
                if part is not None:
                    total[x.shape[1]] = total.get(x.shape[1], 0) + part
        yield rows({(d, i): v for d, m in total.items() for i, v in enumerate(m)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                total[d, i] = total.get((d, i), 0) + v.values.to_numpy()
        yield rows(total)

    schema = "d int, i int, v array<double>"
    table = vectors.mapInArrow(run, schema).repartition("d", "i").mapInArrow(add, schema).toArrow().sort_by([("d", "ascending"), ("i", "ascending")])
    found: dict[int, list[np.ndarray]] = {}
    for d, v in zip(table.column("d").to_pylist(), table.column("v")):
        found.setdefault(d, []).append(v.values.to_numpy())
    return {d: np.array(m) for d, m in found.items()}


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(number, mean, covariance) of the usable vectors of the most frequent dimension, scaled to length 1."""
    found = _totals(vectors, lambda x: np.vstack([x.T @ x, x.sum(axis=0), np.full(x.shape[1], float(len(x)))]))
    if not found:
        return None
    d = min(found, key=lambda d: (-found[d][-1, 0], d))
    n = found[d][-1, 0]
    mean = found[d][-2] / n
    cov = found[d][:d] / n - np.outer(mean, mean)
    return int(n), mean, (cov + cov.T) / 2


def fit(vectors: DataFrame, mean: np.ndarray, cov: np.ndarray, rotations: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """Projections of shape (rotations, d, bits), learned over all of vectors(embedding)."""
    d = len(mean)
    bits = min(BITS, d)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :bits]
    turns = np.array([np.linalg.qr(np.random.default_rng(11 + k).normal(size=(bits, bits)))[0] for k in range(rotations)])
    for _ in range(rounds):

        def step(x: np.ndarray, turns: np.ndarray = turns) -> np.ndarray | None:
            if x.shape[1] != d:
                return None
            v = (x - mean) @ axes
            return np.vstack([np.where(v @ turn >= 0, 1.0, -1.0).T @ v for turn in turns])

        sums = _totals(vectors, step)[d].reshape(rotations, bits, bits)
        for k in range(rotations):
            u, _, vt = np.linalg.svd(sums[k])
            turns[k] = (u @ vt).T
        turns = turns.copy()
    return axes @ turns


def flip_rate(threshold: float, spread: float) -> float:
    """Share of bits in which a pair at the threshold differs, `spread` being the mean squared length after centring."""
    cosine = 1 - (1 - threshold) / max(spread, 1e-9)
    return min(0.45, math.acos(max(-1.0, min(1.0, cosine))) / math.pi)


def plan_tables(n: int, rate: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, number of tables): about one unrelated vector a bucket, and a pair at the
    threshold shares one of the buckets with probability recall."""
    bits = max(4, min(62, math.ceil(math.log2(max(2, n)))))
    hit = (1 - rate) ** bits
    return bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 2


def radius_of(rate: float, bits: int) -> int:
    """Bits in which a pair at the threshold may differ: the mean and three deviations."""
    return math.ceil(bits * rate + 3 * math.sqrt(bits * rate * (1 - rate)))


def encode(vectors: DataFrame, mean: np.ndarray, projections: np.ndarray, width: int, tables: int) -> DataFrame:
    """(h1, h2, first, unit, code, keys) of vectors(h1, h2, first, embedding): code is that of the first rotation, keys are
    the substrings; unusable vectors are left out."""
    rotations, d, bits = projections.shape
    flat = projections.transpose(1, 0, 2).reshape(d, rotations * bits)
    weights, places = np.uint64(1) << np.arange(64, dtype=np.uint64), np.arange(width * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch, 3):
                if x.shape[1] != d or not len(rows):
                    continue
                on = (x - mean) @ flat >= 0
                code = (on[:, :bits] * weights[:bits]).sum(axis=1, dtype=np.uint64).view(np.int64)
                keys = (on[:, places].reshape(len(rows), tables, width) * weights[:width]).sum(axis=2, dtype=np.uint64).view(np.int64)
                at = pa.array(rows)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * d), pa.array(x.ravel().astype(np.float32)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), unit, pa.array(code), lists], names=["h1", "h2", "first", "unit", "code", "keys"])

    return vectors.mapInArrow(run, "h1 bigint, h2 bigint, first bigint, unit array<float>, code bigint, keys array<bigint>")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def cut_groups(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """rows(uid, keys...) with columns group, side and both: each two rows of equal keys are in exactly one group together, on
    different sides or where both sides are one. Groups of more than `block` rows are cut by hash, and their
    cuts meet pairwise."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*keys, F.ceil(F.col("n") * 2 / block).cast("int").alias("k"))
    marked = rows.join(_few(large), keys, "left").withColumn("i", F.pmod(F.xxhash64("uid"), F.coalesce("k", F.lit(1))).cast("int"))
    meets = F.expr("transform(sequence(0, coalesce(k, 1) - 1), x -> struct(least(i, x) as i, greatest(i, x) as j, if(i <= x, 0, 1) as side, i = x as both))")
    spread = marked.withColumn("m", F.explode(meets))
    return spread.select(*[c for c in rows.columns if c not in keys], F.concat_ws(":", *keys, "m.i", "m.j").alias("group"), F.col("m.side").alias("side"), F.col("m.both").alias("both"))


def _join_labels(near: np.ndarray, at: int, label: np.ndarray, tree: list[tuple[int, int]]) -> None:
    """Adds to tree the edges from `at` to one of each other part among near, and makes them one part."""
    other, first = np.unique(label[near], return_index=True)
    if len(other) > 1 or len(other) and other[0] != label[at]:
        tree += [(at, int(k)) for k, o in zip(near[first], other) if o != label[at]]
        label[np.isin(label, other)] = label[at]


def ties(posts: DataFrame, radius: int) -> DataFrame:
    """(a, b): within each group of posts(group, side, both, uid, code), what connects the members whose codes
    differ in at most `radius` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            group, side, both, uid, code = (t.column(k).combine_chunks() for k in range(5))
            group, side, both, uid = group.dictionary_encode().indices.to_numpy(), side.to_numpy(), both.to_numpy(zero_copy_only=False), uid.to_numpy()
            code = code.to_numpy().view(np.uint64)
            found = []
            edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            size = np.repeat(np.diff(edge), np.diff(edge))
            few = np.flatnonzero((size > 1) & (size <= SMALL))
            g, c, u = group[few], code[few], uid[few]  # groups this small are never cut
            for k in range(1, SMALL):
                hit = np.flatnonzero((g[k:] == g[:-k]) & (np.bitwise_count(c[k:] ^ c[:-k]) <= radius)) if len(g) > k else ()
                found.append(np.stack([u[hit], u[np.add(hit, k, dtype=np.int64)]], axis=1) if len(hit) else np.zeros((0, 2), dtype=np.int64))
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo > SMALL:
                    tree: list[tuple[int, int]] = []
                    c, label = code[lo:hi], np.arange(hi - lo)
                    for i in range(hi - lo):
                        near = np.bitwise_count(c ^ c[i]) <= radius
                        if not both[lo]:
                            near &= side[lo:hi] != side[lo + i]
                        _join_labels(np.flatnonzero(near), i, label, tree)
                    found.append(uid[lo:hi][np.array(tree, dtype=np.int64).reshape(-1, 2)])
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            left = pa.concat_tables([left, t]) if left is not None else t
            if left.num_rows >= 1 << 17:  # all but the last group, which may go on
                group = left.column(0)
                whole = pa.compute.index(group, group[-1]).as_py()
                if whole:
                    yield solve(left.slice(0, whole))
                    left = left.slice(whole)
        if left is not None and left.num_rows:
            yield solve(left)

    return posts.select("group", "side", "both", "uid", "code").mapInArrow(run, "a bigint, b bigint")


def rerank(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n partners of a where b is null, else an edge that connects a group. blocks(group, side, both, uid, unit) comes
    sorted by group and uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, a, b, n = None, [], [], [], []

        def solve() -> None:
            if len(items) < 2:
                return
            side, uid, x = np.array([i[0] for i in items]), [i[2] for i in items], np.array([i[3] for i in items], dtype=np.float64)
            links, label, tree = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), []
            for lo in range(0, len(x), 256):
                near = x[lo : lo + 256] @ x.T >= threshold
                if not items[0][1]:
                    near &= side[lo : lo + 256, None] != side[None]
                near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
                links[lo : lo + 256] = near.sum(axis=1)
                for i in np.flatnonzero(near.any(axis=1)):
                    _join_labels(np.flatnonzero(near[i]), lo + int(i), label, tree)
            some = np.flatnonzero(links).tolist()
            a.extend([uid[i] for i in some] + [uid[i] for i, _ in tree])
            b.extend([None] * len(some) + [uid[j] for _, j in tree])
            n.extend([int(links[i]) for i in some] + [0] * len(tree))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])
            for x in (a, b, n):
                x.clear()
            return out

        for batch in batches:
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for i, (group, *about) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if group != now:
                    solve()
                    now, items = group, []
                    if len(a) > 50_000:
                        yield flush()
                items.append((*about, values[offsets[i] : offsets[i + 1]].copy()))
        solve()
        yield flush()

    return blocks.select("group", "side", "both", "uid", "unit").mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, group_id, n_links, n_equal), a row for each vec_id and vector."""
    spark = vectors.sparkSession
    shared_dir(spark)  # components() checkpoints
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null")
    hashed = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    # only ids and 128-bit hashes are shuffled to find copies
    members = write_table(hashed.select("vec_id", "h1", "h2").distinct(), "vector-members")
    zero = F.lit(0).cast("bigint")
    # the model is that of the distinct vectors: copies would draw the mean to themselves
    classes = write_table(hashed.where("size(embedding) > 0").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")), "vector-classes")
    known = moments(classes.select("embedding"))
    if known is None:
        return members.select("vec_id", F.col("vec_id").alias("group_id"), zero.alias("n_links"), zero.alias("n_equal"))
    n, mean, cov = known
    rate = flip_rate(threshold, float(np.trace(cov)))
    width, tables = plan_tables(n, rate, recall)
    bits = min(BITS, len(mean))
    projections = fit(classes.select("embedding"), mean, cov, -(-width * tables // bits), rounds)
    coded = write_table(encode(classes, mean, projections, width, tables).withColumn("uid", F.monotonically_increasing_id()), "vector-codes")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts = coded.select("uid", "code", F.posexplode("keys").alias("t", "key"))
    met = cut_groups(posts, ["t", "key"], block)
    tied = write_table(ties(met.repartition("group").sortWithinPartitions("group", "uid"), radius_of(rate, bits)), "vector-ties")
    parts = components(tied).select(F.col("v").alias("uid"), "c")
    blocks = coded.select("uid", "unit").join(_few(cut_groups(parts, ["c"], block)), "uid")
    found = write_table(rerank(blocks.repartition(tasks, "group").sortWithinPartitions("group", "uid"), threshold), "vector-links")

    links = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("v", "uid")
    first = coded.select("uid", "h1", "h2", "first")
    linked = first.join(links, "uid").join(groups, "uid")  # whoever has a link has a group
    linked = linked.join(linked.groupBy("c").agg(F.min("first").alias("group_id")), "c").select("uid", "n_links", "group_id")
    equal = members.groupBy("h1", "h2").agg((F.count("*") - 1).alias("n_equal"))
    about = first.join(equal, ["h1", "h2"]).join(linked, "uid", "left").where("n_links > 0 or n_equal > 0").select("h1", "h2", F.coalesce("group_id", "first").alias("group_id"), F.coalesce("n_links", zero).alias("n_links"), "n_equal")
    return members.join(about, ["h1", "h2"], "left").select("vec_id", F.coalesce("group_id", "vec_id").alias("group_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_equal", zero).alias("n_equal"))
