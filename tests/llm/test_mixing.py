import random

from pyspark.sql import functions as F

from weftgraph.llm import mixing

from .helpers import EN, FR, crowded, docs, hard_rows, prose, rows_of, same


def corpus(spark, n=400):
    rng = random.Random(10)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr"])
        text = prose(rng, EN if lang == "en" else FR, rng.randrange(5, 200)) + rng.choice(["", "", " licensed to all", " a | b"])
        rows.append((i, text, lang, rng.choice(["hot"] * 6 + ["a", "b", "c"])))
    return docs(spark, rows)


def test_against_sql(spark, tmp_path):
    d = corpus(spark).unionByName(docs(spark, hard_rows())).cache()
    same(mixing.mix(d), mixing.oracle(), d, tmp_path)


def test_targets_against_sql(spark, tmp_path):
    d = corpus(spark).unionByName(docs(spark, hard_rows())).cache()
    for targets in (mixing.TARGETS, {"source": {"a": 0.5, "hot": 0.0}}):
        same(mixing.mix(d, targets), mixing.oracle(targets), d, tmp_path)


def test_targets_of_zero_stay_zero(spark):
    d = corpus(spark)
    for targets in ({"source": {"hot": 1.0}}, {"source": {"hot": 0.5, "a": 0.5, "b": 0.0}}, {"source": {"hot": 1.0}, "lang": {"xx": 1.0}}):
        got = mixing.mix(d, targets).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("probability").alias("p")).collect()
        p = {r.source: r.p for r in got}
        assert p["b"] == p["c"] == 0 and (p["hot"] > 0) == ("lang" not in targets)


def test_a_column_of_topics_is_used(spark):
    d = corpus(spark).withColumn("topic", F.when(F.col("doc_id") % 3 == 0, F.lit("law")))
    by = {r.topic: r.n for r in mixing.mix(d, {"topic": {"law": 0.5}}).groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert by["law"] == 134 and set(by) == {"law", "prose", "license", "table"}
    assert mixing.sample_mix(d).columns == d.columns


def test_marginals_meet_their_targets(spark):
    targets = {"source": {"hot": 0.25, "a": 0.25, "b": 0.25, "c": 0.25}, "lang": {"en": 0.5, "fr": 0.5}}
    raked = mixing.rake(mixing.cells(corpus(spark)), targets, rounds=40).cache()
    for dimension, wanted in targets.items():
        got = {r[0]: r[1] for r in raked.groupBy(dimension).agg(F.sum("weight")).collect()}
        assert all(abs(got[k] - v) < 1e-3 for k, v in wanted.items())


def test_probabilities_keep_the_fraction(spark):
    raked = mixing.rake(mixing.cells(corpus(spark)))
    both = raked.join(mixing.probabilities(raked, 0.6), list(mixing.DIMENSIONS))
    kept, every, top = both.agg(F.sum(F.col("p") * F.col("tokens")), F.sum("tokens"), F.max("p")).first()
    assert abs(kept / every - 0.6) < 1e-9 and top <= 1.0


def test_sample_is_a_function_of_ids(spark):
    d = corpus(spark)
    a = {r.doc_id for r in mixing.sample_mix(crowded(d)).collect()}
    b = {r.doc_id for r in mixing.sample_mix(d.repartition(7)).collect()}
    assert a == b == {r.doc_id for r in mixing.mix(d).where("keep").collect()}
    assert 0.5 < len(a) / d.count() < 0.95


def test_hard_rows(spark):
    d = docs(spark, hard_rows())
    assert mixing.mix(d).count() == d.count()
    assert rows_of(mixing.mix(crowded(d))) == rows_of(mixing.mix(d))
    assert mixing.sample_mix(crowded(d)).columns == crowded(d).columns
    for empty in (docs(spark, []), docs(spark, [(1, None)])):
        assert mixing.mix(empty).count() == empty.count()
