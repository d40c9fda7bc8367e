import random
import re
from itertools import combinations

import numpy as np

from weftgraph.llm import ngram_join as N

from .helpers import EN, FR, crowded, docs, hard_rows, prose, rows_of, same


def grams(text):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + N.N]) for i in range(len(words) - N.N + 1)) or frozenset([tuple(words)])


def brute(rows):
    """Groups of the documents that chains of pairs connect."""
    sets = {i: grams(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= N.THRESHOLD:
                pairs[a, b] = j
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, pairs, {i: find(i) for i in parent}


def corpus(seed=15):
    rng = random.Random(seed)
    shared = prose(rng, EN, 60)  # a passage in many documents that are otherwise different
    rows = []
    for i in range(120):
        rows.append((i, prose(rng, EN, rng.randrange(40, 300)) + (" " + shared if i % 3 == 0 else "")))
    for k in range(60):  # copies with edits
        words = rows[k % 20][1].split()
        for _ in range(rng.randrange(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = rng.choice(FR)
        rows.append((200 + k, " ".join(words)))
    base = prose(rng, EN, 100)
    rows += [(400 + k, base + f" {k}") for k in range(80)]  # a group of many
    rows += [(600 + k, prose(random.Random(3), EN, 50).upper() if k % 2 else prose(random.Random(3), EN, 50)) for k in range(10)]  # copies
    return rows


def wanted(rows):
    """{doc_id: (group_id, n_links, n_equal)}"""
    sets, pairs, group = brute(rows)
    linked, equal = {i: set() for i in sets}, {i: 0 for i in sets}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            if sets[x] == sets[y]:
                equal[x] += 1
            else:
                linked[x].add(sets[y])
    return {i: (group[i], len(linked[i]), equal[i]) for i in sets}


def found(df):
    rows = df.collect()
    got = {r.doc_id: (r.group_id, r.n_links, r.n_equal) for r in rows}
    assert len(got) == len(rows)
    return got


def test_groups_and_links_are_those_of_brute_force(spark):
    rows = corpus()
    want = wanted(rows)
    assert sum(n for _, n, _ in want.values()) > 6000
    assert found(N.near_groups(docs(spark, rows))) == want


def test_other_thresholds_and_lengths(spark):
    rows = corpus(19)
    for n, threshold in ((3, 0.8), (2, 0.35)):
        old = N.N, N.THRESHOLD
        N.N, N.THRESHOLD = n, threshold
        try:
            want = wanted(rows)
        finally:
            N.N, N.THRESHOLD = old
        assert found(N.near_groups(docs(spark, rows), n, threshold)) == want


def test_no_pair_is_lost_in_small_chunks_and_long_lists(spark, monkeypatch):
    rows = corpus(20)
    want = wanted(rows)
    send = N._send_codes
    # the workers take the module's names as they are when the function is sent
    monkeypatch.setattr(N, "CHUNK_TOKENS", 3000)
    monkeypatch.setattr(N, "HOT", 3)
    assert send is N._send_codes
    assert found(N.near_groups(docs(spark, rows).repartition(3))) == want


def test_packed_numbers_come_back():
    rng = np.random.default_rng(18)
    for hi in (1, 200, 70_000, 1 << 47, 1 << 56):
        for n in (0, 1, 2, 500):
            x = np.sort(rng.integers(0, hi, n))
            assert (N._unpack(N._pack(x)) == x).all()


def test_a_passage_ties_no_other_documents(spark):
    """Thousands of documents share a passage that is not half of them: none gets past the lists."""
    rng = random.Random(4)
    passage = prose(rng, EN, 150)
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(160 + i % 200))) for i in range(20_000)]
    d = docs(spark, rows)
    counted = N._count_lists(N._send_codes(N._rows(d), 3, 4).repartition(4, "p").sortWithinPartitions("p"))
    left = N._gather(counted.repartition(4, "target").sortWithinPartitions("target"), N.THRESHOLD)
    assert left.where("codes is not null").count() == 0


def test_against_sql(spark, tmp_path):
    d = docs(spark, corpus(16) + [r[:2] for r in hard_rows()]).cache()
    same(N.near_groups(d), N.oracle(), d, tmp_path)


def test_t_occurrence_counts_exactly():
    rng = np.random.default_rng(17)
    for _ in range(150):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(rng.integers(1, 25))]
        if rng.random() < 0.3:
            lists.append(np.arange(60))
        t = int(rng.integers(1, 8))
        ids, counts = np.unique(np.concatenate([x for x in lists]), return_counts=True)
        got = N.t_occurrence(lists, t)
        assert dict(zip(*(x.tolist() for x in got))) == {int(i): int(c) for i, c in zip(ids, counts) if c >= t}


def test_heap_and_run_merge_agree(monkeypatch):
    rng = np.random.default_rng(21)
    lists = [np.unique(rng.integers(0, 500, rng.integers(0, 400))) for _ in range(60)]
    monkeypatch.setattr(N, "HEAP_ENTRIES", 1 << 30)
    by_heap = [x.tolist() for x in N.t_occurrence(lists, 20)]
    monkeypatch.setattr(N, "HEAP_ENTRIES", 0)
    assert [x.tolist() for x in N.t_occurrence(lists, 20)] == by_heap and len(by_heap[0]) > 100


def test_one_of_each_group_stays(spark):
    rows = corpus()
    _, _, group = brute(rows)
    d = crowded(docs(spark, rows))
    kept = N.drop_near_copies(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))


def test_large_parts_are_cut_into_blocks(spark):
    rows = corpus()
    for tokens in (700, 5000):
        assert found(N.near_groups(docs(spark, rows), block_tokens=tokens)) == wanted(rows)


def test_hard_rows(spark):
    d = docs(spark, hard_rows())
    kept = [r.doc_id for r in N.drop_near_copies(crowded(d)).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12] and kept.count(None) == 1
    assert rows_of(N.near_groups(crowded(d))) == sorted([(i, i, 0, 0) for i in (1, 2, 3, 6, 7, 8, 9, 10, 11, 12)] + [(4, 4, 0, 1), (5, 4, 0, 1)], key=repr)
    assert N.near_groups(docs(spark, [])).count() == 0 and N.drop_near_copies(docs(spark, [])).count() == 0


def test_one_of_several_equal_rows_stays(spark):
    text = prose(random.Random(6), EN, 50)
    rows = [(1, text)] * 3 + [(2, text)] + [(3, None)] * 2 + [(4, "...")] * 2
    assert sorted(r.doc_id for r in N.drop_near_copies(docs(spark, rows)).collect()) == [1, 3, 3, 4, 4]
