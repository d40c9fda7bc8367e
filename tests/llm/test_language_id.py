import random

import numpy as np

from weftgraph.llm import language_id as L

from .helpers import EN, FR, crowded, docs, hard_rows, prose


def corpus(spark, n=300):
    rng = random.Random(18)
    return docs(spark, [(i, prose(rng, FR if i % 3 == 0 else EN, rng.randrange(5, 200)), ("fr" if i % 3 == 0 else "en") if i < n // 2 else None) for i in range(n)])


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in L.identify(corpus(spark)).collect()}
    assert np.mean([got[i].predicted_lang == ("fr" if i % 3 == 0 else "en") for i in range(150, 300)]) > 0.98
    assert np.mean([r.keep for r in got.values()]) > 0.99


def test_noise_is_rejected(spark):
    rng = random.Random(19)
    noise = [(1000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(400)), None) for i in range(20)] + [(2000, "12 34 !!", None)]
    got = {r.doc_id: r for r in L.identify(corpus(spark).unionByName(docs(spark, noise))).collect()}
    assert not any(got[i].keep for i, *_ in noise)
    assert got[2000].predicted_lang == "und"


def test_probabilities_add_up(spark):
    model = L.fit(corpus(spark))
    for context in (0, 5, 5 * L.WIDTH + 3, (20 * L.WIDTH + 8) * L.WIDTH + 5):
        p = np.exp(model.log_prob(context * L.WIDTH + np.arange(L.WIDTH)))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-3)


def test_model_against_a_plain_version():
    """Counts and interpolation by dictionaries."""
    rng = random.Random(20)
    text = prose(rng, EN, 300)
    codes, _ = L.grams([text], L.WIDTH, False)
    c, n = np.unique(codes, return_counts=True)
    model = L.KneserNey(["en"], np.zeros(len(c), dtype=int), c, n)
    counts = {4: dict(zip(c.tolist(), n.tolist()))}
    for order in (3, 2, 1):
        counts[order] = {}
        for g in counts[order + 1]:
            counts[order][g % L.WIDTH**order] = counts[order].get(g % L.WIDTH**order, 0) + 1

    def prob(code, order):
        if not order:
            return 1 / L.WIDTH
        table = counts[order]
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [v for g, v in table.items() if g // L.WIDTH == code % L.WIDTH**order // L.WIDTH]
        low = prob(code, order - 1)
        if not same:
            return low
        here = table.get(code % L.WIDTH**order, 0)
        return (max(here - d, 0) if here else 0) / sum(same) + d * len(same) / sum(same) * low

    some = rng.sample(c.tolist(), 30) + [rng.randrange(L.WIDTH**4) for _ in range(30)]
    want = [np.log(prob(x, 4)) for x in some]
    assert np.allclose(model.log_prob(np.array(some))[:, 0], want, atol=1e-3)


def test_hard_rows(spark):
    d = corpus(spark).unionByName(docs(spark, hard_rows()))
    got = L.identify(crowded(d))
    assert got.count() == d.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert not any(by_id[i].keep for i in (1, 2, 3, 8)) and by_id[6].keep and by_id[6].predicted_lang == "en"
    kept = L.keep_identified(crowded(d))
    assert kept.columns == crowded(d).columns
    assert kept.count() == got.where("keep").count()
    unlabelled = docs(spark, [(1, "some words", None)])
    assert [r.keep for r in L.identify(unlabelled).collect()] == [False]
    assert L.keep_identified(unlabelled).count() == 0
    assert L.identify(docs(spark, [])).count() == 0
