import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup

from .helpers import EN, crowded, docs, hard_rows, prose, rows_of, same


def test_directory_splits_and_doubles():
    rng = random.Random(3)
    counts = np.zeros(1 << 8, dtype=np.int64)
    for _ in range(5000):
        counts[rng.randrange(1 << 4) if rng.random() < 0.5 else rng.randrange(1 << 8)] += 1
    depth, bucket, local = exact_dedup.grow_directory(counts, capacity=100, max_depth=8)
    assert len(bucket) == 1 << depth and depth == local.max()
    load = {}
    for p, n in enumerate(counts):
        at = p >> (8 - depth)
        load[bucket[at]] = load.get(bucket[at], 0) + n
    for b, n in load.items():
        at = np.flatnonzero(bucket == b)
        assert len(at) == 1 << (depth - local[at[0]])  # a bucket has all positions of its prefix
        assert n <= 100 or local[at[0]] == 8


def test_index_is_owned_by_ranges(spark):
    d = docs(spark, [(i, f"text {i % 700}") for i in range(1500)])
    entries, directory = exact_dedup.build_index(d, capacity=50)
    assert entries.count() == 700 and sorted({r.n for r in entries.collect()}) == [2, 3]  # a row a key, with its chain
    owners = entries.select("bucket", F.input_file_name().alias("f")).groupBy("bucket").agg(F.countDistinct("f").alias("n"))
    assert owners.where("n > 1").count() == 0
    assert directory.count() == 1 << directory.agg(F.max("local_depth")).first()[0]


def test_against_sql_and_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [prose(rng, EN, 5) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    d = docs(spark, rows).cache()
    same(exact_dedup.exact_dedup(d, 16), exact_dedup.oracle(), d, tmp_path)
    want = {}
    for i, t in rows:
        want[t] = min(i, want.get(t, i))
    assert {r.doc_id for r in exact_dedup.drop_copies(d).collect()} == set(want.values())


def test_colliding_keys_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_key", lambda text="text": F.when(F.col(text).isNotNull(), F.lit(7).cast("bigint")))
    d = docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])
    assert rows_of(exact_dedup.exact_dedup(d)) == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True)]


def test_the_depth_follows_the_entries(spark):
    for n in (200, 5000):
        d = spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text")
        entries, directory = exact_dedup.build_index(d, capacity=8)
        load = entries.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first()
        assert load[0] <= 8 and load[1] == n


def test_owners_add_up_chains_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = docs(spark, [(i, f"text {i * i % 11}") for i in range(200)])
        entries, _ = exact_dedup.build_index(d, capacity=16)
        want = {}
        for i in range(200):
            want[i * i % 11] = want.get(i * i % 11, 0) + 1
        assert sorted(r.n for r in entries.collect()) == sorted(want.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hard_rows(spark):
    d = docs(spark, hard_rows())
    kept = exact_dedup.drop_copies(crowded(d))
    assert kept.columns == crowded(d).columns
    ids = sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None)
    assert [i for i, _ in ids] == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert kept.where("doc_id is null").count() == 1  # its null text equals nothing; the copy of 4 goes
    assert exact_dedup.exact_dedup(d).count() == d.count()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0
