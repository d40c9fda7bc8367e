"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

T-occurrence search: a document is a query whose n-grams name inverted lists; a partner must
occur on at least T of them. DivideSkip merges the short lists by a heap and probes the long ones by
binary search. Which documents must meet at all is decided first, exactly:

1. Lists. Chunks of documents send their sorted n-gram codes, packed as differences, to owners of code
   ranges. An owner counts each n-gram's documents and returns those of more than one: lists of length
   one can't connect anything. A document with fewer than T = ceil(threshold * size) n-grams on
   longer lists has no partner and is done; that is most documents, and all that only share a passage.
2. Routing. The lists of the others are ordered by length. All but the T - 1 longest are short, and
   a partner that is no larger must have one of them among the short ones of its own, of which
   there are fewer, as the overlap of two sets of like size must be larger. Lists are split by ranges of
   size. Chunks first tie what they hold of a list to one member and send that one, so a list of
   any length costs the number of chunks. This loses no pair.
3. Blocks. What these ties connect makes a block of at most `BLOCK_TOKENS` n-grams; a larger part is
   cut by size ranges and hashes, and its cuts meet pairwise where their sizes allow a pair. In a block
   each set queries the inverted lists of the sets before it, smaller ones first, and a partner is
   linked if the Jaccard reaches the threshold.

Pairs are counted, not emitted: the result has one row a document with its number of links, and the
spanning edges of a block give the groups. Equal sets are one query, so thousands of copies cost their number.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A text of fewer than n
words is one n-gram of all its words. n-grams are told apart by 48-bit hashes: two sets of 300 n-grams
share one by chance once in 3 * 10**9 pairs. Edge cases: null texts and texts without words link to
nothing; rows equal in doc_id and text are one document; rows with a null doc_id are left out of
near_groups but count in drop_near_copies; ties of size are ordered by row number.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, write_table
from .components import components

N = 3
THRESHOLD = 0.5
CHUNK_TOKENS = 1 << 21
BLOCK_TOKENS = 1_000_000
#: n-gram codes have so many bits
CODE_BITS = 48
#: A list with more documents than this in one chunk isn't sent to its owner, only its length
HOT = 64
#: The constant mu of the list-splitting rule L = T / (mu * log M + 1).
MU = 0.0085
#: Short lists of up to so many entries are merged by a heap, more by one merge of their sorted runs.
HEAP_ENTRIES = 1024
BROADCAST_ROWS = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram codes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _WORD[b]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = np.flatnonzero(start)
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return [none] * len(texts)
    drop = np.uint64(64 - CODE_BITS)
    with np.errstate(over="ignore"):
        step = np.arange(len(b), dtype=np.int64) - np.repeat(np.append(0, at), np.diff(np.concatenate([[0], at, [len(b)]])))
        power = np.cumprod(np.full(int(step.max()) + 2, 0x9E3779B97F4A7C15, dtype=np.uint64))
        word = _mix(np.add.reduceat(np.where(inside, (_LOWER[b].astype(np.uint64) + np.uint64(1)) * power[step], np.uint64(0)), at))
        first = np.zeros(len(raw), dtype=np.int64)
        first[1:] = np.cumsum([len(r) + 1 for r in raw[:-1]])
        begin = np.searchsorted(at, first)
        end = np.append(begin[1:], len(word))
        gram = word.copy()
        for k in range(1, n):
            gram[: len(gram) - k] = _mix(gram[: len(gram) - k] * np.uint64(0xD6E8FEB86659FD93) + word[k:])
        gram = (gram >> drop).view(np.int64)
        out = []
        for s, e in zip(begin, end):
            if e - s >= n:
                out.append(np.unique(gram[s : e - n + 1]))
            elif e > s:
                h = word[s : s + 1]
                for k in range(s + 1, e):
                    h = _mix(h * np.uint64(0xA24BAED4963EE407) + word[k : k + 1])
                out.append((h >> drop).view(np.int64))
            else:
                out.append(none)
    return out


def least_overlap(size: int | np.ndarray, threshold: float, smaller: bool = False):
    """n-grams that a set shares with any partner; with any partner that is no smaller."""
    share = 2 * threshold / (1 + threshold) if smaller else threshold
    return np.maximum(1, np.ceil(share * np.asarray(size) - 1e-9)).astype(np.int64)


def size_class(size: np.ndarray, threshold: float) -> np.ndarray:
    """Sets of which one is at most 1 / threshold times the other are of the same or of neighbouring classes."""
    return np.floor(np.log(size) / math.log(1 / threshold) + 1e-9).astype(np.int64) if 0 < threshold < 1 else np.asarray(size, dtype=np.int64)


def t_occurrence(lists: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, occurrences) of all ids on at least t of the sorted lists, by DivideSkip."""
    none = np.zeros(0, dtype=np.int64)
    if t < 1 or len(lists) < t:
        return none, none
    lists = sorted(lists, key=len, reverse=True)
    n_long = min(t - 1, int(t / (MU * math.log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    need = t - n_long
    if sum(map(len, short)) <= HEAP_ENTRIES:
        counts: dict[int, int] = {}
        runs = [x.tolist() for x in short if len(x)]
        heap = [(x[0], i, 0) for i, x in enumerate(runs)]
        heapq.heapify(heap)
        while heap:
            top, n = heap[0][0], 0
            while heap and heap[0][0] == top:
                _, i, j = heap[0]
                n += 1
                if j + 1 < len(runs[i]):
                    heapq.heapreplace(heap, (runs[i][j + 1], i, j + 1))
                else:
                    heapq.heappop(heap)
            if n >= need:
                counts[top] = n
        ids, found = np.fromiter(counts, dtype=np.int64), np.fromiter(counts.values(), dtype=np.int64)
    else:
        merged = np.sort(np.concatenate(short), kind="stable")  # it finds and merges the runs
        edge = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        found = np.diff(np.append(edge, len(merged)))
        ok = found >= need
        ids, found = merged[edge][ok].astype(np.int64), found[ok]
    for k, x in enumerate(long):
        if not len(ids):
            break
        if len(x):
            at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
            found = found + (x[at] == ids)
        ok = found + (len(long) - 1 - k) >= t
        if not ok.all():
            ids, found = ids[ok], found[ok]
    return ids, found


def _pack(x: np.ndarray) -> tuple[int, int, bytes]:
    """Sorted integers as the first one and the differences in as few bytes as the largest needs."""
    if not len(x):
        return 0, 1, b""
    steps = np.diff(x, prepend=x[0])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return int(x[0]), width, np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(packed: tuple[int, int, bytes]) -> np.ndarray:
    first, width, data = packed
    steps = np.zeros((len(data) // width, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return first + np.cumsum(steps.view("<u8").ravel().view(np.int64)) if len(steps) else np.zeros(0, dtype=np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, dtype=np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, lengths[i] numbers each."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


_SENT = "p int, target bigint, kind int, data binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["p", "target", "kind", "data"])


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(value, [(target, kind, data)]) of each run of equal values in a column of sent rows."""
    now, rows = None, []
    for batch in batches:
        keys, targets, kinds = batch.column(column).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for key, target, kind, data in zip(keys, targets, kinds, batch.column(3)):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append((target, kind, data.as_py()))
    if rows:
        yield now, rows


def _send_codes(rows: DataFrame, n: int, parts: int) -> DataFrame:
    """What chunks of rows(row, doc_id, text) send: kind 0 to the owner p of a range of codes, kind 1 what
    the chunk keeps for itself (its documents, and its lists that are long already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, count = TaskContext.get().partitionId() << 32, 0
        limits = np.array([(i << CODE_BITS) // parts for i in range(parts + 1)], dtype=np.int64)
        known: dict[tuple[int, int, int], int] = {}
        sets, about, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal known, sets, about, held, count
            code = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.argsort(code, kind="stable")
            code, owner = code[at], owner[at]
            edge = _runs(code)
            length, code = np.diff(edge), code[edge[:-1]]
            hot = length > HOT
            cut = np.searchsorted(code, limits)
            chunk, out = home + count, []
            for p in range(parts):
                lo, hi = cut[p], cut[p + 1]
                if hi > lo:
                    cold = ~hot[lo:hi]
                    docs = owner[_spread(edge[lo:hi][cold], length[lo:hi][cold])]
                    out.append((p, chunk, 0, pickle.dumps((int(lo), _pack(code[lo:hi]), np.where(hot[lo:hi], 0, length[lo:hi]).astype(np.uint8), length[lo:hi][hot[lo:hi]], _small(docs)), 5)))
            place = np.flatnonzero(hot)
            out.append((chunk % parts, chunk, 1, pickle.dumps((about, place, length[place], _small(owner[_spread(edge[place], length[place])])), 5)))
            known, sets, about, held = {}, [], [], 0
            count += 1
            return _sent(out)

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, _, part in chunks(batch.column(2).to_pylist()):
                for i, s in enumerate(gram_sets(part, n), lo):
                    with np.errstate(over="ignore"):
                        sign = len(s), int(s.sum()), int(_mix(s.view(np.uint64)).sum().view(np.int64)) if len(s) else 0
                    at = -1  # an equal set of this chunk speaks for it
                    if len(s) and sign not in known:
                        at = known[sign] = len(sets)
                        sets.append(s)
                        held += len(s)
                    about.append((keys[i], ids[i], *sign, at))
                if held >= CHUNK_TOKENS or len(about) >= 1 << 16:
                    yield flush()
        if about:
            yield flush()

    return rows.mapInArrow(run, _SENT)


def _count_lists(sent: DataFrame) -> DataFrame:
    """Owners count the documents of each code and return those of several to the chunks: kind 0; kind 1 passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _grouped(batches, 0):
            parts = [(target, *pickle.loads(data)) for target, kind, data in rows if kind == 0]
            out = [(p, target, kind, data) for target, kind, data in rows if kind == 1]
            rows.clear()
            codes, lengths = [], []
            for _, _, packed, n, hot, _ in parts:
                codes.append(_unpack(packed))
                n = n.astype(np.int64)
                n[n == 0] = hot
                lengths.append(n)
            if parts:
                every = np.concatenate(codes)
                at = np.argsort(every, kind="stable")
                edge = _runs(every[at])
                total = np.empty(len(every), dtype=np.int64)
                total[at] = np.repeat(np.add.reduceat(np.concatenate(lengths)[at], edge[:-1]), np.diff(edge))
                done = 0
                for (target, base, _, n, _, docs), code in zip(parts, codes):
                    df = total[done : done + len(code)]
                    done += len(code)
                    keep = np.flatnonzero(df > 1)
                    # lengths in steps of an eighth of a doubling: any order will do that all agree on
                    rank = np.minimum(255, np.floor(8 * np.log2(df[keep]))).astype(np.uint8)
                    begin = np.cumsum(n, dtype=np.int64) - n
                    out.append((p, target, 0, pickle.dumps((_pack(code[keep]), rank, n[keep], docs[_spread(begin[keep], n[keep].astype(np.int64))], keep[n[keep] == 0].astype(np.uint32) + base), 5)))
            yield _sent(out)

    return sent.mapInArrow(run, _SENT)


_GATHERED = "row binary, doc_id bigint, size int, s1 bigint, s2 bigint, codes array<bigint>"


def _gather(counted: DataFrame, threshold: float) -> DataFrame:
    """A row a document, with its codes on lists of several, shortest lists first, if there are enough for a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            about, place, hot_length, hot_docs = pickle.loads(next(data for _, kind, data in rows if kind == 1))
            hot_begin = np.cumsum(hot_length) - hot_length
            code, rank, doc = [], [], []
            for _, kind, data in rows:
                if kind == 0:
                    packed, r, n, docs, hot = pickle.loads(data)
                    c, n = _unpack(packed), n.astype(np.int64)
                    at = np.searchsorted(place, hot)
                    code += [np.repeat(c, n), np.repeat(c[n == 0], hot_length[at])]
                    rank += [np.repeat(r, n), np.repeat(r[n == 0], hot_length[at])]
                    doc += [docs.astype(np.int64), hot_docs[_spread(hot_begin[at], hot_length[at])].astype(np.int64)]
            rows.clear()
            code, rank, doc = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (code, rank, doc))
            keys, ids, size, s1, s2, at = ([x[k] for x in about] for k in range(6))
            n = sum(a >= 0 for a in at)
            whole = np.zeros(n, dtype=np.int64)
            whole[[a for a in at if a >= 0]] = [s for s, a in zip(size, at) if a >= 0]
            keep = np.bincount(doc, minlength=n) >= least_overlap(whole, threshold)
            ok = keep[doc]
            code, rank, doc = code[ok], rank[ok], doc[ok]
            order = np.lexsort((code, rank, doc))
            code, begin = code[order], np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
            mine = [a >= 0 and bool(keep[a]) for a in at]
            lengths = [begin[a + 1] - begin[a] if m else 0 for a, m in zip(at, mine)]
            # documents are in the order in which they were numbered, so their codes are too
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(code), mask=pa.array([not m for m in mine]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(ids, type=pa.int64()), pa.array(size, type=pa.int32()), pa.array(s1, type=pa.int64()), pa.array(s2, type=pa.int64()), lists], names=[x.split()[0] for x in _GATHERED.split(", ")])

    return counted.mapInArrow(run, _GATHERED)


def _send_short(sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Ties within chunks of sets(uid, size, codes): kind 1; and to the owner p of a range of lists one member
    of each list: kind 0. A list is a code and a range of sizes, and its hub a set that could be the smaller of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array([(i << (CODE_BITS + 8)) // parts for i in range(parts + 1)], dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, uid, role = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((uid, role, key))
            key, uid, role = key[order], uid[order], role[order]
            edge = _runs(key)
            first, length = edge[:-1], np.diff(edge)
            tied = (role[first] == 0) | (length > HOT)  # a list with a hub, or too long to be sent
            in_tied = np.repeat(tied, length)
            hub = np.repeat(uid[first], length)
            pairs = np.unique(np.stack([hub, uid], axis=1)[in_tied & (hub != uid)], axis=0)
            stays = ~in_tied
            stays[first] = True
            key, uid, role = key[stays], uid[stays], role[stays]
            cut = np.searchsorted(key, limits)
            names, at = np.unique(uid, return_inverse=True)
            out = [(p, 0, 0, pickle.dumps((_pack(key[lo:hi]), _small(at[lo:hi]), role[lo:hi], _pack(names)), 5)) for p, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]
            return _sent([*out, (int(len(key)) % parts, 0, 1, pickle.dumps(pairs, 5))])

        for batch in batches:
            size = batch.column(1).to_numpy().astype(np.int64)
            offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            m, kind = np.diff(offsets), size_class(size, threshold)
            probes = m - least_overlap(size, threshold) + 1
            hubs = np.maximum(0, m - least_overlap(size, threshold, True) + 1)
            code = values[_spread(offsets[:-1].astype(np.int64), probes)]
            place = _spread(np.zeros(len(m), dtype=np.int64), probes)
            uid, kind, role = (np.repeat(x, probes) for x in (batch.column(0).to_numpy(), kind, hubs))
            role = (place >= role).astype(np.uint8)
            held.append((code << 8 | kind, uid, role))
            below = kind > 0  # smaller partners can be one class below
            held.append((code[below] << 8 | (kind[below] - 1), uid[below], np.ones(below.sum(), dtype=np.uint8)))
            if sum(len(x[0]) for x in held) >= CHUNK_TOKENS:
                yield flush()
        if held:
            yield flush()

    return sets.mapInArrow(run, _SENT)


def _tie_lists(sent: DataFrame) -> DataFrame:
    """(a, b): ties between the members of each list that has a hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            pairs = [pickle.loads(data) for _, kind, data in rows if kind == 1]
            parts = [pickle.loads(data) for _, kind, data in rows if kind == 0]
            if parts:
                key = np.concatenate([_unpack(k) for k, _, _, _ in parts])
                uid = np.concatenate([_unpack(names)[at] for _, at, _, names in parts])
                role = np.concatenate([r for _, _, r, _ in parts])
                order = np.lexsort((uid, role, key))
                key, uid, role = key[order], uid[order], role[order]
                edge = _runs(key)
                length = np.diff(edge)
                hub = np.repeat(uid[edge[:-1]], length)
                ok = np.repeat(role[edge[:-1]] == 0, length) & (hub != uid)
                pairs.append(np.stack([hub, uid], axis=1)[ok])
            pairs = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return sent.mapInArrow(run, "a bigint, b bigint")


def _in_blocks(placed: DataFrame, threshold: float, block_tokens: int) -> DataFrame:
    """(uid, block, side, both) of placed(uid, c, size, kind): each two sets of a part that could be a pair by
    their sizes are together in exactly one block, on different sides or where both sides are one."""
    # a part's classes of sizes, and by class its number of cuts: at most some thirty classes a part
    cuts = placed.groupBy("c", "kind").agg(F.sum("size").alias("s"))
    cuts = cuts.groupBy("c").agg(F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("kind", F.ceil(F.col("s") * 2 / block_tokens).cast("int")))).alias("k"))
    met = placed.join(cuts, "c").withColumn("i", F.pmod(F.xxhash64("uid"), F.element_at("k", F.col("kind"))).cast("int"))
    small = F.array(F.struct(F.lit(-1).cast("bigint").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("step"), F.lit(0).alias("side"), F.lit(True).alias("both")))
    large = F.expr(
        """flatten(array(
  transform(sequence(0, element_at(k, kind) - 1), x -> struct(kind, least(i, x) as i, greatest(i, x) as j, 0 as step, if(i <= x, 0, 1) as side, i = x as both)),
  if(element_at(k, kind + 1) is null, array(), transform(sequence(0, coalesce(element_at(k, kind + 1), 1) - 1), x -> struct(kind, i, x as j, 1 as step, 0 as side, false as both))),
  if(element_at(k, kind - 1) is null, array(), transform(sequence(0, coalesce(element_at(k, kind - 1), 1) - 1), x -> struct(kind - 1 as kind, x as i, i as j, 1 as step, 1 as side, false as both)))))"""
    )
    spread = met.select("uid", "c", F.explode(F.when(F.col("s") <= block_tokens, small).otherwise(large)).alias("x"))
    return spread.select("uid", F.concat_ws(":", "c", "x.kind", "x.i", "x.j", "x.step").alias("block"), F.col("x.side").alias("side"), F.col("x.both").alias("both"))


def link(codes: list[np.ndarray], size: np.ndarray, side: np.ndarray, both: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(number of partners of each set, spanning edges of the pairs); sets come in order of size."""
    n = len(codes)
    off = np.append(0, np.cumsum([len(c) for c in codes]))
    code, owner = np.concatenate(codes), np.repeat(np.arange(n), np.diff(off))
    at = np.argsort(code, kind="stable")
    owner = owner[at]
    edge = _runs(code[at])
    start = np.repeat(edge[:-1], np.diff(edge))
    place = np.empty(len(at), dtype=np.int64)
    place[at] = np.arange(len(at))
    least = np.searchsorted(size, np.ceil(threshold * size - 1e-9))  # the first set that is large enough
    need = least_overlap(size, threshold)
    links, tree, label = np.zeros(n, dtype=np.int64), [], np.arange(n)
    for q in range(n):
        end = place[off[q] : off[q + 1]]
        begin = start[end]
        listed = end > begin  # sets before q on each list
        if least[q] >= q or listed.sum() < need[q]:
            continue
        ids, shared = t_occurrence([owner[a:b] for a, b in zip(begin[listed].tolist(), end[listed].tolist())], int(need[q]))
        ok = (ids >= least[q]) & (shared >= threshold * (size[ids] + size[q] - shared)) & (both | (side[ids] != side[q]))
        ids = ids[ok]
        if not len(ids):
            continue
        links[ids] += 1
        links[q] += len(ids)
        other, first = np.unique(label[ids], return_index=True)
        if len(other) > 1 or other[0] != label[q]:
            tree += [(q, int(k)) for k, o in zip(ids[first], other) if o != label[q]]
            label[np.isin(label, other)] = label[q]
    return links, tree


def _link_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n partners of a where b is null, else a spanning edge. blocks(block, uid, size, side, both,
    codes) comes sorted by block, size and uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, a, b, n = None, [], [], [], []

        def solve() -> None:
            if len(items) > 1:
                uid = [x[0] for x in items]
                links, tree = link([x[4] for x in items], np.array([x[1] for x in items]), np.array([x[2] for x in items]), items[0][3], threshold)
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
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            for i, (block, *about) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
                if block != now:
                    solve()
                    now, items = block, []
                    if len(a) > 50_000:
                        yield flush()
                items.append((*about, values[offsets[i] : offsets[i + 1]].copy()))
        solve()
        yield flush()

    return blocks.mapInArrow(run, "a bigint, b bigint, n bigint")


def _few(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it is measured to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _join(rows: DataFrame, n: int, threshold: float, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of rows(row, doc_id, text): members(row, doc_id, size, s1, s2, n_rows), a row a document, and
    classes(size, s1, s2, first, n_equal, n_links, group), a row a set; first and group are structs that end in
    doc_id and row, of the first document of the set and of the group."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # owners hold some CHUNK_TOKENS codes each, at seven bytes a word or more
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(tasks, -(-size // (7 * CHUNK_TOKENS)))
    counted = _count_lists(_send_codes(rows, n, parts).repartitionById(parts, "p").sortWithinPartitions("p"))
    home = F.expr("cast(pmod((target >> 32) + (target & 4294967295) * 7919, 1048573) as int)")  # chunks of a task go to different ones
    gathered = _gather(counted.repartitionById(parts, home).sortWithinPartitions("target"), threshold)
    gathered = write_table(gathered.withColumn("uid", F.monotonically_increasing_id()), "ngram-sets")

    own = F.when(F.col("codes").isNotNull(), F.col("uid"))
    members = gathered.select("row", "doc_id", "size", "s1", "s2", own.alias("uid")).groupBy("row", "doc_id", "size", "s1", "s2").agg(F.min("uid").alias("uid"), F.count("*").alias("n_rows"))
    members = write_table(members, "ngram-members")
    first = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")
    classes = members.where("size > 0").groupBy("size", "s1", "s2").agg(F.min(first).alias("first"), (F.count("*") - 1).alias("n_equal"), F.min("uid").alias("uid"))
    classes = write_table(classes, "ngram-classes")

    chosen = classes.where("uid is not null").select("uid")
    sets = gathered.where("codes is not null").select("uid", "size", "codes").join(_few(chosen), "uid", "left_semi")
    ties = _tie_lists(_send_short(sets, threshold, tasks).repartitionById(tasks, "p").sortWithinPartitions("p"))
    parts_of = components(write_table(ties, "ngram-ties"))
    kind = F.floor(F.log("size") / math.log(1 / threshold) + 1e-9) if 0 < threshold < 1 else F.col("size")
    placed = parts_of.select(F.col("v").alias("uid"), "c").join(classes.select("uid", "size"), "uid").withColumn("kind", kind.cast("bigint")).checkpoint()
    # linking costs time, not bytes: a number of tasks that is given isn't merged for small size
    blocks = sets.join(_few(_in_blocks(placed, threshold, block_tokens)), "uid").repartition(2 * tasks, "block").sortWithinPartitions("block", "size", "uid")
    found = write_table(_link_blocks(blocks.select("block", "uid", "size", "side", "both", "codes"), threshold), "ngram-links")

    links = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("v", "uid")
    linked = classes.join(links, "uid").join(groups, "uid")  # whoever has a link has a group
    leads = linked.groupBy("c").agg(F.min("first").alias("group"))
    linked = linked.join(leads, "c").select("uid", "n_links", "group")
    all_classes = classes.join(linked, "uid", "left").select("size", "s1", "s2", "first", "n_equal", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("group", "first").alias("group"))
    return members, all_classes


def _row_key():
    """A 128-bit digest of doc_id and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary")))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def near_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, group_id, n_links, n_equal), a row a document: group_id is the smallest doc_id that chains of
    pairs at or over the threshold connect, n_links the number of other n-gram sets that make a pair with the
    document's, n_equal the number of other documents of the same set."""
    members, classes = _join(_rows(docs).where("doc_id is not null"), n, threshold, block_tokens)
    some = classes.where("n_links > 0 or n_equal > 0").select("size", "s1", "s2", F.col("group.doc_id").alias("group_id"), "n_links", "n_equal")
    zero = F.lit(0).cast("bigint")
    return members.join(some, ["size", "s1", "s2"], "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_equal", zero).alias("n_equal"))


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without all but one row of each group, that of the smallest doc_id; all columns stay. Rows with
    null texts or without words stay. Of rows equal in doc_id and text any one stays."""
    members, classes = _join(_rows(docs), n, threshold, block_tokens)
    groups = classes.where("n_links > 0 or n_equal > 0").select("size", "s1", "s2", F.col("group.row").alias("lead"))
    row = fresh(docs, "_near_row")
    gone = write_table(members.join(groups, ["size", "s1", "s2"]).where("row <> lead").select(F.col("row").alias(row)), "ngram-gone")
    kept = docs.withColumn(row, _row_key()).join(_few(gone), row, "left_anti")
    twice = members.where("n_rows > 1 and size > 0").select(F.col("row").alias(row))
    if not twice.isEmpty():
        twice = _few(twice)
        kept = kept.join(twice, row, "left_anti").unionByName(kept.join(twice, row, "left_semi").dropDuplicates([row]))
    return kept.select(docs.columns)


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
w AS (SELECT r, doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM d WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) ELSE [array_to_string(w, ' ') || ' #' || len(w)] END)) AS g FROM w WHERE len(w) > 0),
m AS MATERIALIZED (SELECT r, g, min(r) OVER (PARTITION BY g) AS k, min(doc_id) OVER (PARTITION BY g) AS first, count(*) OVER (PARTITION BY g) - 1 AS n_equal FROM s),
t AS MATERIALIZED (SELECT k, len(g) AS size, unnest(g) AS t FROM m WHERE r = k),
p AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM t a JOIN t b ON a.t = b.t AND a.k < b.k
  AND least(a.size, b.size) >= {threshold} * greatest(a.size, b.size) GROUP BY a.k, b.k, a.size, b.size HAVING count(*) >= {threshold} * (a.size + b.size - count(*))),
u AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
l AS (SELECT x AS k, count(*) AS n_links FROM u GROUP BY x),
cc(id, c) USING KEY (id) AS (SELECT DISTINCT x, x FROM u UNION (SELECT u.y, min(cc.c) FROM cc JOIN u ON u.x = cc.id JOIN recurring.cc k ON k.id = u.y WHERE cc.c < k.c GROUP BY u.y)),
f AS MATERIALIZED (SELECT cc.id AS k, min(m.first) OVER (PARTITION BY cc.c) AS group_id FROM cc JOIN m ON m.r = cc.id)
SELECT d.doc_id, coalesce(f.group_id, m.first, d.doc_id) AS group_id, coalesce(l.n_links, 0) AS n_links, coalesce(m.n_equal, 0) AS n_equal
FROM d LEFT JOIN m ON m.r = d.r LEFT JOIN l ON l.k = m.k LEFT JOIN f ON f.k = m.k"""
