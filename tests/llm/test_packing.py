import random
from itertools import combinations

from weftgraph.llm import packing

from .helpers import EN, crowded, docs, hard_rows, prose


def optimum(sizes, capacity):
    """Fewest bins by dynamic programming over subsets."""
    best = {0: (0, capacity)}
    full = (1 << len(sizes)) - 1
    for mask in range(full + 1):
        if mask not in best:
            continue
        n, used = best[mask]
        for i, s in enumerate(sizes):
            if not mask >> i & 1:
                to = (n, used + s) if used + s <= capacity else (n + 1, s)
                if mask | 1 << i not in best or to < best[mask | 1 << i]:
                    best[mask | 1 << i] = to
    return best[full][0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(6)
    for _ in range(120):
        sizes = [rng.randint(8, 60) for _ in range(rng.randint(1, 11))]
        bins = packing.bin_completion(sizes, 100)
        assert sorted(x for b in bins for x in b) == sorted(sizes)
        assert all(sum(b) <= 100 for b in bins)
        assert len(bins) == optimum(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(bins) <= len(packing.best_fit(sizes, 100))


def test_search_beats_best_fit():
    sizes = [6, 6, 5, 5, 4, 4, 3, 3, 3, 3, 2, 2, 2, 2]
    rng = random.Random(7)
    better = 0
    for _ in range(300):
        sizes = [rng.randint(15, 50) for _ in range(12)]
        better += len(packing.bin_completion(sizes, 100)) < len(packing.best_fit(sizes, 100))
    assert better


def test_fillings_are_the_undominated_sets():
    rest, room = [40, 30, 20, 20, 10, 5], 55
    sets = {c for n in range(len(rest) + 1) for c in combinations(rest, n) if sum(c) <= room}
    want = {a for a in sets if not any(b != a and packing.dominates(b, a) and not packing.dominates(a, b) for b in sets)}
    got = set(packing.fillings(rest, room, room))
    assert got <= want
    assert all(any(packing.dominates(g, w) for g in got) for w in want)
    assert packing.dominates((40,), (20, 20)) and not packing.dominates((20, 20), (40,))


def test_fillings_come_whole_at_any_waste():
    rng = random.Random(9)
    for _ in range(60):
        rest, room = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 9))), reverse=True), rng.randint(0, 60)
        sets = {c for n in range(len(rest) + 1) for c in combinations(rest, n) if sum(c) <= room}
        want = {a for a in sets if not any(b != a and packing.dominates(b, a) for b in sets)}
        for waste in (0, 3, room):
            got = list(packing.fillings(rest, room, waste))
            assert len(got) == len(set(got)) and set(got) == {a for a in want if room - sum(a) <= waste}


def test_a_spent_budget_leaves_the_incumbent():
    rng = random.Random(10)
    sizes = [rng.randint(15, 50) for _ in range(40)]
    for steps in (0, 1, 50):
        bins = packing.bin_completion(sizes, 100, steps=steps)
        assert sorted(x for b in bins for x in b) == sorted(sizes)
        assert len(bins) <= len(packing.best_fit(sizes, 100))


def test_every_token_is_packed_once(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, EN, rng.randrange(0, 400))) for i in range(200)] + [(900, prose(rng, EN, 2500))] + hard_rows()
    got = packing.pack(crowded(docs(spark, rows)), capacity=500, bins=8).collect()
    fill, pieces = {}, {}
    for r in got:
        if r.bin_id is not None:
            fill.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
    for spans in fill.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= 500
    words = lambda t: len((t or "").split())
    want = {}
    for r in rows:
        want[r[0]] = want.get(r[0], 0) + words(r[1])
    assert {k: sum(v) for k, v in pieces.items()} == want
    assert sorted(pieces[900]) == [500] * 5
    assert all(r.bin_id is None for r in got if r.n_tokens == 0)


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_equal_rows_spread_over_groups(spark):
    got = packing.pack(docs(spark, [(None, "a b c d e")] * 4000), capacity=100, bins=4).collect()
    assert len(got) == 4000
    groups = [r.bin_id >> 24 for r in got]
    assert len(set(groups)) == 50 and max(groups.count(g) for g in set(groups)) < 200
