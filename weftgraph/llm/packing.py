"""Best-fit packing of documents into training sequences by bin completion.

A sequence holds `capacity` tokens (words). A longer document fills whole sequences and leaves a
rest, so no token is cut off. Pieces hash into groups of about `bins` sequences; each group is
packed for itself, so packing scales with the number of groups and only (id, length) is shuffled.

In a group, bin completion takes the largest piece left and enumerates the undominated fillings of
the room beside it: maximal sets of other pieces, without any whose pieces fit, bin-wise,
into those of another. Fillings are made one by one in levels of waste, as the search asks for them. A branch ends when its waste exceeds
what a solution better than the incumbent can afford; best-fit-decreasing solutions, of the
group and of what each node leaves, are the incumbents. The search of a group has a budget of `nodes` and of
steps (the problem is NP-hard); when either is spent the search ends and the incumbent stands, so every piece is always packed.

Edge cases: a document without tokens (null, empty, blank) is returned without a bin; equal lengths
are interchangeable and taken in order of doc_id, null first; repeated rows are packed each and spread over
all groups, however many they are; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .mixing import tokens_of

CAPACITY = 2048
BINS = 64
NODES = 400
#: Branches that a group's enumerations of fillings may enter, all together
STEPS = 100_000
SCHEMA = "bin_id bigint, doc_id bigint, piece int, bin_offset int, n_tokens int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # sorted (room, bin)
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(room, (s, -1))
        if i == len(room):
            bins.append([s])
            bisect.insort(room, (capacity - s, len(bins) - 1))
        else:
            left, b = room.pop(i)
            bins[b].append(s)
            bisect.insort(room, (left - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's L2: pieces over half a bin, and what can't share with the largest ones."""
    desc = sorted(sizes, reverse=True)
    sums = [0]
    for s in desc:
        sums.append(sums[-1] + s)
    neg = [-s for s in desc]
    best = -(-sums[-1] // capacity)
    half = bisect.bisect_left(neg, -(capacity // 2))  # pieces over half a bin
    for k in {s for s in desc if 2 * s <= capacity} | {0}:
        alone = bisect.bisect_left(neg, -(capacity - k))  # pieces > capacity - k
        small = bisect.bisect_right(neg, -k) if k else len(desc)  # pieces >= k
        between = max(alone, half)
        free = (between - alone) * capacity - (sums[between] - sums[alone])
        rest = sums[small] - sums[between]
        best = max(best, between + max(0, -(-(rest - free) // capacity)))
    return best


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b, partitioned, fit into the pieces of a."""
    common = Counter(a) & Counter(b)
    a, b = sorted((Counter(a) - common).elements(), reverse=True), sorted((Counter(b) - common).elements(), reverse=True)

    def place(i: int, room: list[int]) -> bool:
        if i == len(b):
            return True
        for k in range(len(room)):
            if room[k] >= b[i] and room[k] not in room[:k]:
                room[k] -= b[i]
                if place(i + 1, room):
                    return True
                room[k] += b[i]
        return False

    return sum(b) <= sum(a) and place(0, a)


def fillings(rest: list[int], room: int, waste: int, steps: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """The undominated sets of rest that fit the room and leave at most `waste`, one by one, by levels of waste.

    What dominates a set leaves no more and comes first in falling order of its pieces, so a set need only be held
    against those before it. A branch is entered only if pieces that follow add up to an end within the level. Each costs one
    of steps[0]; when these are spent, the sets end."""
    count = Counter(rest)
    sizes = sorted((s for s in count if s <= room), reverse=True)
    waste, mask = min(waste, room), (1 << (room + 1)) - 1
    reach = [1]  # of each place in sizes, reversed: bit x for pieces from there on that add up to x
    for s in reversed(sizes):
        sums = reach[-1]
        for _ in range(min(count[s], room // s)):
            more = sums | sums << s & mask
            if more == sums:
                break
            sums = more
        reach.append(sums)
    reach.reverse()
    steps = [1 << 62] if steps is None else steps
    kept: list[tuple[int, ...]] = []
    low, high = 0, 0
    while low <= waste:
        # place in sizes, room left, pieces, and the smallest size of which a piece was left out
        branches = [(0, room, (), room + 1)]
        while branches:
            if steps[0] <= 0:
                return
            steps[0] -= 1
            i, left, chosen, skipped = branches.pop()
            # maximal: in the end nothing left out would fit
            least, most = max(0, left - min(high, skipped - 1)), left - low
            if most < least or not reach[i] >> least & ((1 << (most - least + 1)) - 1):
                continue
            while i < len(sizes) and sizes[i] > left:
                i += 1
            if i == len(sizes):
                if not any(dominates(k, chosen) for k in kept):
                    kept.append(chosen)
                    yield chosen
                continue
            s = sizes[i]
            for n in range(min(count[s], left // s) + 1):  # the last is taken first
                branches.append((i + 1, left - n * s, chosen + (s,) * n, min(skipped, s) if n < count[s] else skipped))
        low, high = high + 1, min(waste, 2 * high + 1)


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES, steps: int = STEPS) -> list[list[int]]:
    """Bins of sizes, each at most capacity: optimal unless the nodes or steps ran out."""
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    total = sum(sizes)
    spent, budget = 0, [steps]

    def search(rest: list[int], bins: list[list[int]], left: int) -> None:
        nonlocal best, spent
        spent += 1
        done = bins + best_fit(rest, capacity)
        if len(done) < len(best):
            best = done
        # waste that a solution with a bin less than the incumbent can still afford
        afford = (len(best) - 1) * capacity - total - (len(bins) * capacity - (total - left))
        if not rest or afford < 0 or len(best) == bound:
            return
        first, others = rest[0], rest[1:]
        for f in fillings(others, capacity - first, afford, budget):
            used = first + sum(f)
            if len(bins) + 1 + -(-(left - used) // capacity) >= len(best):
                continue
            after, gone = [], Counter(f)
            for s in others:
                if gone[s]:
                    gone[s] -= 1
                else:
                    after.append(s)
            search(after, [*bins, [first, *f]], left - used)
            if spent >= nodes or len(best) == bound:  # before the next filling is sought
                return

    if len(best) > bound:
        search(sorted(sizes, reverse=True), [], total)
    return best


def pack(docs: DataFrame, capacity: int = CAPACITY, bins: int = BINS, nodes: int = NODES) -> DataFrame:
    """(bin_id, doc_id, piece, bin_offset, n_tokens): one row for each piece of each row of docs;
    bin_id is null and n_tokens 0 for a document without tokens."""
    # texts are read once; the row number of what was written is the same whenever a task reads it again
    sized = write_table(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens_of(F.col("text")).alias("n")), "packing-sizes")
    groups = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // (capacity * bins)))
    # packing costs time, not bytes: a number of tasks that is given isn't merged for small size
    # and there are several a core, as the time of a group varies
    tasks = min(groups, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = sized.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")))))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int"))
    placed = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups))).repartitionById(tasks, F.expr(f"cast(g % {tasks} as int)")).sortWithinPartitions("g", "size", "doc_id", "piece").select("g", "doc_id", "piece", "size")

    def solve(group: int, items: list[tuple]) -> Iterator[tuple]:
        queues: dict[int, deque] = {}
        for doc, piece, size in items:
            queues.setdefault(size, deque()).append((doc, piece))
        for doc, piece in queues.pop(0, ()):
            yield None, doc, piece, 0, 0
        full = [capacity] * len(queues.get(capacity, ()))
        open_ = [s for s, q in queues.items() if s < capacity for _ in q]
        solution = [[s] for s in full] + bin_completion(open_, capacity, nodes)
        for i, content in enumerate(solution):
            at = 0
            for s in content:
                doc, piece = queues[s].popleft()
                yield group << 24 | i, doc, piece, at, s
                at += s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, out = None, [], []
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for g, doc, piece, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if g != now:
                    out.extend(solve(now, items))
                    now, items = g, []
                    if len(out) > 50_000:
                        yield flush()
                items.append((doc, piece, size))
        out.extend(solve(now, items))
        yield flush()

    return placed.mapInArrow(run, SCHEMA)
