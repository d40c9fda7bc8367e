import random

import pytest

from weftgraph.llm import sharding

from .helpers import EN, crowded, docs, hard_rows, prose, rows_of, same


def test_against_sql(spark, tmp_path):
    rng = random.Random(1)
    d = docs(spark, [(i, prose(rng, EN, rng.randrange(200))) for i in range(300)] + hard_rows()).cache()
    same(sharding.shard(d, 64, 4), sharding.oracle(64, 4), d, tmp_path)


def test_rebalancing_levels_loads_and_moves_little(spark):
    rng = random.Random(2)
    d = docs(spark, [(i, "x" * (4000 if i < 20 else 100)) for i in range(400)])
    slots = sharding.slot_bytes(d, 128)
    before = sharding.initial_map(spark, 128, 4)
    after = sharding.rebalance(slots, before, 4)
    load = lambda m: sorted(r[0] for r in slots.join(m, "slot").groupBy("shard").sum("bytes").select("sum(bytes)").collect())
    assert load(after)[-1] <= load(before)[-1]
    assert after.count() == 128 and after.select("slot").distinct().count() == 128
    assert rng is not None


def test_versions_never_change(spark, tmp_path):
    store = sharding.SlotMapStore(spark, str(tmp_path / "map"))
    store.write(1, sharding.initial_map(spark, 16, 2))
    with pytest.raises(Exception, match="exist"):
        store.write(1, sharding.initial_map(spark, 16, 4))
    assert store.read(1).select("shard").distinct().count() == 2


def test_rebalancing_again_begins_at_the_latest_version(spark, tmp_path):
    store = sharding.SlotMapStore(spark, str(tmp_path / "map"))
    small = docs(spark, [(i, "x" * (4000 if i < 20 else 100)) for i in range(400)])
    large = docs(spark, [(i, "x" * (9000 if i % 50 == 7 else 100)) for i in range(600)])
    for version, (d, shards) in enumerate([(small, 4), (large, 4), (large, 6), (large, 3)], 2):
        before = {r.slot: r.shard for r in (store.read(version - 1) if version > 2 else sharding.initial_map(spark, 128, 4)).collect()}
        got = sharding.shard(d, 128, shards, store=store).collect()
        now = {r.slot: r.shard for r in store.read(version).collect()}
        assert store.versions() == list(range(1, version + 1)) and set(now) == set(range(128))
        assert all(r.map_version == version and r.shard == now[r.slot] and r.moved == (now[r.slot] != before[r.slot]) for r in got)
        load = [0] * shards
        for r in d.collect():
            load[next(g.shard for g in got if g.doc_id == r.doc_id)] += len(r.text)
        assert max(load) <= 1.3 * sum(load) / shards and max(now.values()) < shards
    with pytest.raises(ValueError, match="slots"):
        sharding.shard(small, 64, 4, store=store)


def test_hard_rows(spark):
    d = docs(spark, hard_rows())
    got = sharding.shard(crowded(d))
    assert got.count() == d.count()
    assert rows_of(got) == rows_of(sharding.shard(d))
    assert sharding.shard(docs(spark, [])).count() == 0
