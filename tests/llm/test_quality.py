import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import quality

from .helpers import EN, FR, crowded, docs, hard_rows, prose, rows_of


def corpus(spark, n=400):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rng, EN, 60) if good else " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in prose(rng, EN, 60).split())
        rows.append((i, text))
        if i < n // 2:
            labels.append((i, int(good), 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    d, labels = corpus(spark)
    got = {r.doc_id: r.keep for r in quality.classify(d, labels).collect()}
    assert np.mean([got[i] == (i % 3 != 0) for i in range(200, 400)]) > 0.97


def test_features_are_those_of_a_plain_count():
    import re

    texts = ["one two two", "", "Ärger, 12x!!", "one", "  a  "]
    idx, starts = quality.features(texts)
    ends = np.append(starts[1:], len(idx))
    for t, s, e in zip(texts, starts, ends):
        words = re.findall("[a-zA-Z\x80-\xff]+|[0-9]+|[^a-zA-Z0-9\x00-\x20\x80-\xff]+", t.encode().decode("latin-1"))
        assert e - s == max(0, 2 * len(words) - 1)
    assert idx[0] == idx[ends[2]]  # the same word in two texts
    assert idx[2] == idx[4]  # 'two' twice


def test_updates_are_ftrl():
    model = quality.Ftrl(10)
    rng = np.random.default_rng(14)
    for _ in range(400):
        y = rng.random() < 0.5
        model.update(np.array([3, 5] if y else [4, 5]), float(y))
    assert model.weight(np.array([3]))[0] > 0.5 and model.weight(np.array([4]))[0] < -0.5
    assert (model.weight(np.arange(100, 200)) == 0).all()  # untouched weights stay exactly zero


def test_hard_rows(spark):
    d, labels = corpus(spark, 200)
    hard = docs(spark, hard_rows())
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 1), (3, 0, 1)], labels.schema))
    got = quality.classify(crowded(d.unionByName(hard)), odd).toPandas()
    assert len(got) == 200 + hard.count() and got.quality_score.between(0, 1).all()
    assert got[got.doc_id.isin([1])].quality_score.nunique() >= 1
    none = quality.classify(hard, labels.limit(0)).toPandas()
    assert (none.quality_score == 0.5).all() and none.keep.all()
    assert quality.classify(docs(spark, []), labels).count() == 0
    further = labels.withColumn("label", F.lit("x")).withColumn("h", F.lit("y")).withColumn("text", F.lit("z"))
    assert rows_of(quality.classify(crowded(d), further)) == rows_of(quality.classify(d, labels))
