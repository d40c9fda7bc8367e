import random

import numpy as np
import pytest

from weftgraph.llm import toxicity as T

from .helpers import EN, FR, crowded, docs, hard_rows, prose

BAD = ["blockhead", "numbskull", "dimwit", "nitwit", "worthless"]


def corpus(seed=11, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, EN if i % 4 else FR, rng.randrange(30, 120)).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic) if i % 37 else int(not toxic)))
    # copies of one labelled document share their contexts, so their words teach nothing
    for i in range(20):
        rows.append((1000 + i, "zanzibar quartet " + prose(random.Random(5), EN, 40)))
        labels.append((1000 + i, 1, 1))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def scorer(spark):
    d, labels = frames(spark)
    return T.Scorer(*T.fit_words(d, labels), T.count_model(d))


def test_lexicon_is_learned_without_copies(scorer):
    assert set(scorer.lexicon) == set(BAD)


@pytest.mark.parametrize("text, word", [("you bl0ckh3ad", "blockhead"), ("d i m w i t", "dimwit"), ("a n-u-m-b-s-k-u-l-l !", "numbskull"), ("n1tw1t", "nitwit"), ("dimmmmwiiiit", "dimwit"), ("W0RTHL3$$", "worthless"), ("n i t w 1 t", "nitwit"), ("ｄｉｍｗｉｔ", "dimwit"), ("𝐝𝐢𝐦𝐰𝐢𝐭", "dimwit"), ("𝓷𝓲𝓽𝔀𝓲𝓽", "nitwit"), ("ⓓⓘⓜⓦⓘⓣ", "dimwit"), ("dіmwіt", "dimwit"), ("blосkhеаd", "blockhead"), ("🅳🅸🅼🆆🅸🆃", "dimwit"), ("DΙMWΙT", "dimwit")])
def test_obfuscated_words_are_restored(scorer, text, word):
    assert [w for w, _ in scorer.hits([text])[0]] == [word]


@pytest.mark.parametrize("text", ["the block headed home", "a dim wit of the year", "1 2 3 4 5 6", "", "with it", "nit pick wit", "www.example.com/0/1"])
def test_clean_text_is_left_alone(scorer, text):
    assert scorer.hits([text])[0] == []


def test_model_is_a_distribution(scorer):
    p = np.exp(scorer.model.astype(float)).sum(axis=-1)
    assert np.allclose(p, 1, atol=1e-4)


def test_spans_are_those_of_brute_force(scorer):
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        words = prose(rng, EN, 30).split()
        for _ in range(2):
            w = rng.choice(BAD)
            w = rng.choice([w, w.replace("i", "1").replace("o", "0"), " ".join(w), ".".join(w), w[0] * 4 + w[1:], w.upper() + "!"])
            words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
    together = scorer.hits(texts)
    assert together == [scorer.hits([t])[0] for t in texts]  # texts of a chunk don't touch
    whole = [sorted(w for w in T.decode(t, scorer.model).split() if w in scorer.lexicon) for t in texts]
    agree = sum(sorted(w for w, _ in h) == v for h, v in zip(together, whole))
    assert agree >= 58  # decoding the whole text and decoding its spans give the same words


def by_enumeration(text, model):
    """The least cost of all ways through the lattice, and the readings that have it."""
    found = {}

    def go(i, last, again, cost, out):
        a, b, c = last
        if i == len(text):
            if c:
                cost -= float(model[a, b, c, 0])
            said = " ".join(out.split())
            found[said] = min(cost, found.get(said, cost))
            return
        ch, letter = text[i], T._fold(text[i])
        emits = [(ord(letter) - 96, 0.0)] if letter else [(ord(x) - 96, T.C_LEET) for x in T.LEET.get(ch, "")]
        drop, keep = (0.0, 0.0 if ch in T.PUNCTUATION else T.C_SYMBOL) if emits else T._spacing(text, i)
        for x, price in emits:
            go(i + 1, (b, c, x) if c else (0, 0, x), False, cost + price - float(model[a, b, c, x]), out + chr(96 + x))
            if c == x:
                go(i + 1, last, True, cost + (T.C_AGAIN if again else T.C_REPEAT), out)
        if not letter:
            if not c:
                go(i + 1, (0, 0, 0), False, cost, out)
            else:
                go(i + 1, (0, 0, 0), False, cost + keep - float(model[a, b, c, 0]), out + " ")
                if not emits:
                    go(i + 1, last, again, cost + drop, out)

    go(0, (0, 0, 0), False, 0.0, "")
    least = min(found.values())
    return {k for k, v in found.items() if v < least + 1e-9}


def test_decoding_is_the_best_of_all_ways(scorer):
    rng = random.Random(31)
    assert by_enumeration("n 1 t w i t", scorer.model) == {"nitwit"}
    for _ in range(300):
        text = "".join(rng.choice("aadeiinotww1!0|. -$9") for _ in range(rng.randrange(0, 9)))
        assert T.decode(text, scorer.model) in by_enumeration(text, scorer.model), text


def test_copies_of_a_labelled_text_outweigh_nothing():
    rng = random.Random(7)
    rows = [(1.0, prose(rng, EN, 20) + " dimwit " + prose(rng, EN, 9)) for _ in range(12)] + [(0.0, prose(rng, EN, 40)) for _ in range(100)]
    lexicon, _ = T.learn_words(rows + [(1.0, "one dimwit here")] * 60)
    assert "dimwit" in lexicon


def test_detects_held_out_documents(spark):
    d, labels = frames(spark)
    fresh, truth = corpus(seed=99, n=200)
    got = {r.doc_id: r for r in T.detect(d.unionByName(docs(spark, [(i + 5000, t) for i, t in fresh if i < 1000])), labels).collect()}
    for i, _ in fresh:
        if i < 1000:
            r = got[i + 5000]
            assert r.toxic == (i % 5 == 0) and r.keep != r.toxic


def test_hard_rows(spark):
    d, labels = frames(spark)
    hard = docs(spark, hard_rows() + [(77, "b l o c k h e a d " * 3)])
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (123456, 1, 1)], labels.schema))
    got = T.detect(crowded(d.unionByName(hard)), odd)
    assert got.count() == d.count() + hard.count()
    assert {r.doc_id for r in got.where("toxic and doc_id = 77").collect()} == {77}
    assert got.where("doc_id is null or doc_id in (1, 2, 6, 12)").where("toxic").count() == 0
    none = labels.limit(0)
    assert T.detect(d, none).where("toxic").count() == 0
    assert T.detect(docs(spark, []), labels).count() == 0
