"""What grows with the input: shuffles of whole rows, tables that loops leave behind, tasks that parse."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph import queries as Q
from weftgraph.operators import analyze, build, extract, markdown, search
from weftgraph.plans.storage import numbered, shared_folder, stored

SF = "/root/testdata/sf0.001"


def left_behind(spark, run) -> int:
    """Tables and checkpoints that run adds to the shared folder, while its result is alive."""

    def all_of() -> set:
        base = shared_folder(spark).removeprefix("file://")
        return {os.path.join(at, d) for at, folders, _ in os.walk(base) for d in folders if d.startswith("rdd-") or os.path.basename(at) == "tables"}

    before = all_of()
    result = run()
    assert result.count() > 0
    return len(all_of() - before)


def chain(spark, n: int):
    """A path of n nodes against the order of their ids, as (nodes, edges)."""
    ids = spark.range(n).select(F.format_string("n%03d", F.lit(n) - F.col("id")).alias("id"), F.format_string("n%03d", F.lit(n) - F.col("id") - 1).alias("to"), build.ord_of(F.lit(0), F.col("id")).alias("ord"))
    edges = ids.where("to <> 'n000'").select("ord", F.col("id").alias("source"), F.col("to").alias("target"), F.lit("next").alias("relation"), F.lit(1.0).alias("confidence_score"))
    return ids.select("ord", "id"), edges


def test_page_rank_keeps_one_state_and_ends_when_all_is_fixed(spark):
    nodes, edges = chain(spark, 4)
    loop = []
    assert left_behind(spark, lambda: loop.append(analyze.page_rank(nodes, edges, one_task_edges=1)) or loop[0]) <= 2
    want = {r.id: r["rank"] for r in analyze.page_rank(nodes, edges).collect()}
    got = {r.id: r["rank"] for r in loop[0].collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_page_rank_with_a_cycle_and_a_tail(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "a"), ("d", "a"), ("c", "c"), ("x", "a")], "source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    want = {r.id: r["rank"] for r in analyze.page_rank(n, e, iterations=7).collect()}
    got = {r.id: r["rank"] for r in analyze.page_rank(n, e.where("source <> 'x'"), iterations=7, one_task_edges=1).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_costs_keep_one_state(spark):
    nodes, edges = chain(spark, 6)
    assert left_behind(spark, lambda: search.distances(edges, nodes.where("id = 'n006'"))) <= 1
    got = {r.id: (r.cost, r.parent) for r in search.distances(edges, nodes.where("id = 'n006'")).collect()}
    assert got == {f"n{i:03}": (6.0 - i, f"n{i + 1:03}" if i < 6 else None) for i in range(1, 7)}


def test_components_keep_one_state(spark):
    nodes, edges = chain(spark, 9)
    assert left_behind(spark, lambda: analyze.components(nodes, edges)) <= 2
    assert {r.root for r in analyze.components(nodes, edges).collect()} == {"n001"}


def test_edges_are_not_shuffled_whole(spark):
    edges = Q.entities(spark, SF)[1].select("source", "target")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # of repeated keys


def test_numbers_need_one_shuffle(spark):
    df = numbered(spark.range(100).select((F.col("id") * 37 % 100).alias("k")), "k")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1  # of the counts
    assert all(r.k == r["index"] for r in df.collect())


def test_scripts_are_spread_over_tasks(spark, tmp_path):
    spark.range(20000, numPartitions=1).select(F.md5(F.col("id").cast("string")).alias("id")).write.parquet(f"{tmp_path}/t")
    items = spark.read.parquet(f"{tmp_path}/t").coalesce(1).withColumn("text", F.col("id"))
    assert extract.spread(items).rdd.getNumPartitions() >= 4


def test_components_by_stars_and_hooks(spark):
    """Small chunks and tasks, so that all steps are taken; each way gives the smallest id."""
    nodes, path = chain(spark, 40)
    assert {r.root for r in analyze.components(nodes, path, chunk=3, one_task=1).collect()} == {"n001"}
    pairs = [(f"n{i:03}", f"n{i * 7 % 41:03}") for i in range(1, 41) if i % 5] + [("n001", "n001")]
    some = spark.createDataFrame(pairs, "source string, target string")
    got = {r.id: r.root for r in analyze.components(nodes, some, chunk=2, one_task=1).collect()}
    want = {f"n{i:03}": f"n{i:03}" for i in range(1, 41)}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_components_shuffle_stars_not_edges(spark):
    """Many edges of few vertices leave a task as few rows."""
    links = spark.range(50000, numPartitions=1).select((F.col("id") % 100).alias("a"), (F.col("id") % 100 + 1).alias("b"))
    assert analyze._stars(links, 1000).count() <= 51 * 101


def test_stored_tables_are_read_in_shares(spark):
    """A table that one task wrote is read by several, and the session keeps its values."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    one = stored(spark.range(1_500_000, numPartitions=1).select(F.md5(F.col("id").cast("string")).alias("id")), "one")
    sizes = stored(one, "many").groupBy(F.input_file_name()).count().collect()
    assert len([r for r in sizes if r["count"]]) >= 3
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_validation_names_lost_and_missing_ends(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "")], "id string, label string")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("x", "a"), ("a", "x"), (None, "a")], "source string, target string")
    want = ["Edge source 'null' does not match any node.", "Edge source 'x' does not match any node."] + ["Edge target 'x' does not match any node."] * 2 + ["Node b missing label."]
    assert sorted(r.message for r in build.validate(nodes, edges).collect()) == want
    plan = build.validate(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # edges are held against few lost ends, not shuffled


def test_cut_vertices_by_contraction(spark):
    """Small chunks and groups, so that all steps are taken: no component has to fit in a task."""
    rng = random.Random(7)
    for n, m in ((30, 34), (60, 75), (25, 18), (40, 120)):
        ids = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)]
        want = set(analyze.articulation_points(ids, [p for p in pairs if p[0] != p[1]]))
        links = spark.createDataFrame(pairs, "a bigint, b bigint")
        assert {r.id for r in analyze.cut_vertices(links, chunk=7, one_task=5).collect()} == want
        assert {r.id for r in analyze.cut_vertices(links).collect()} == want


def test_contraction_keeps_cut_vertices():
    """One group after another, with any homes: what is left and what is found give the cut vertices of all."""
    none = np.zeros(0, np.int64)
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(3, 30))
        ids = np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
        u, w = rng.choice(ids, (2, int(rng.integers(1, 2 * n))))
        want = set(analyze.articulation_points(ids.tolist(), [(a, b) for a, b in zip(u.tolist(), w.tolist()) if a != b]))
        parts, found, rest = int(rng.integers(1, 5)), set(), [[], [], []]
        home = analyze._home(ids, parts)
        where = dict(zip(ids.tolist(), home.tolist()))
        at, far = np.array([where[x] for x in u.tolist()]), np.array([where[x] for x in w.tolist()])
        for p in range(parts):
            cut, a, b, tails = analyze._contracted(u[at == p], w[at == p], none, np.unique(w[(far == p) & (at != p)]), lambda x, p=p: analyze._home(x, parts) == p)
            found |= set(cut.tolist())
            for k, part in enumerate((a, b, tails)):
                rest[k].append(part)
        a, b, tails = map(np.concatenate, rest)
        last = analyze._contracted(a, b, tails, none, lambda x: np.ones(len(x), bool))
        assert not len(last[1]) and not len(last[3])
        assert found | set(last[0].tolist()) == want, seed


def test_few_keys_are_not_sorted(spark):
    """Rows that share a few ids are hashed: sorted, all rows of a task would be held."""
    nodes = spark.range(1000, numPartitions=2).select(build.ord_of(F.lit(0), F.col("id")).alias("ord"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("id"), F.col("id").cast("string").alias("label"))
    found = build.dedupe_nodes(nodes)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.ord.pos, r.label) for r in found.collect()) == [("n0", 0, "999"), ("n1", 1, "997"), ("n2", 2, "998")]


def test_a_key_that_all_rows_share_is_shuffled_twice_a_chunk():
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 50 + [k])], names=["_hash"]) for k in range(4)]
    assert sorted(x for b in build._twice(iter(batches)) for x in b.column(0).to_pylist()) == [0, 1, 2, 3, 7, 7]


def test_hashes_are_shuffled_in_runs():
    """A chunk leaves its task as at most a row a range; equal numbers meet, those at both ends of the ranges too."""
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 1]
    rows = np.concatenate([np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 50000), ends, ends[::2]]).astype(np.int64)
    batches = list(build._runs(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["_hash"])])))
    assert sum(b.num_rows for b in batches) <= build.RANGES
    parts = {}
    for b in batches:
        for place, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts.setdefault(place, []).append(run)
    assert sorted(np.concatenate([np.frombuffer(x, np.int64) for runs in parts.values() for x in runs])) == sorted(rows)
    apart = [build._repeated(iter([pa.RecordBatch.from_arrays([pa.array([p] * len(runs)), pa.array(runs, pa.binary())], names=["_range", "_run"])])) for p, runs in parts.items()]
    assert sorted(x for some in apart for b in some for x in b.column(0).to_pylist()) == sorted(ends[::2])


def test_update_of_a_built_graph_reads_edges_once(spark):
    """What a sound graph takes in is held against what is new; the result is that of the full check."""
    nodes, edges = Q.entities(spark, SF)
    affected = spark.createDataFrame([("customers:5",), ("customers:3",)], "source_item_id string")
    new = nodes.where("source_item_id = 'customers:3'").withColumn("label", F.lit("new"))
    links = edges.where("source_item_id = 'customers:3'")
    links = links.unionByName(links.withColumn("relation", F.lit("more"))).unionByName(edges.where("relation = 'supplies'").limit(3).withColumn("confidence", F.lit("AMBIGUOUS")).withColumn("ord", F.struct(F.lit(9).alias("epoch"), "ord.item", "ord.pos", "ord.sub")))
    got, want = (build.update(nodes, edges, None, (new, links), affected, sound=sound) for sound in (True, False))
    for a, b in zip(got[:2], want[:2]):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_update_of_files_writes_no_whole_table(spark, monkeypatch):
    """A graph that is files under a few expressions is not written before it is changed; ids are not sorted."""
    rows, plans = {}, []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        found = stored(df, name)
        rows[name] = max(rows.get(name, 0), found.count())
        return found

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(build, "stored", noted)
        monkeypatch.setattr(Q, "stored", noted)
        got = Q.incremental_update_edges(spark, SF).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(rows.values()) < got / 5, rows
    assert not [name for name, plan in plans if "SortMergeJoin" in plan]


def test_graph_of_files_is_that_of_written_tables(spark):
    """Repeated and dangling rows, links and nulls, with and without tables in between."""
    n = [(0, "a", "A", None), (1, "b", "B", None), (2, "a", "A2", None), (3, "r", "R", "b"), (4, "r", "R", "x")]
    e = [(0, "a", "b", "x", "i"), (1, "a", "b", "x", "i"), (2, "a", "b", "x", None), (3, "a", "z", "x", "i"), (4, None, "a", "x", "i"), (5, "a", "r", "links_to", "i"), (6, "b", "a", None, None)]
    at = build.ord_of(F.lit(0), F.col("k")).alias("ord")
    nodes = spark.createDataFrame(n, "k int, id string, label string, href string").select(at, "id", "label", F.lit("document").alias("type"), F.lit("i").alias("source_item_id"), "href", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("source_url"))
    edges = spark.createDataFrame(e, "k int, source string, target string, relation string, source_item_id string").select(at, "source", "target", "relation", "source_item_id", F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("source_location"))
    got, want = build.build(nodes, edges, written=False), build.build(nodes, edges)
    for a, b in zip(got, want):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert got[1].count() == 4
    # an update whose relation is null, and one whose relation old edges have
    new = edges.where("ord.pos in (1, 2, 6)").withColumn("ord", F.struct(F.lit(9).alias("epoch"), "ord.item", "ord.pos", "ord.sub")).withColumn("confidence", F.lit("INFERRED"))
    for some in (new, new.where("relation is not null"), new.withColumn("relation", F.lit("other"))):
        a, b = build.add_edges(got[1], build.complete(some, got[1].columns), sound=True), build.add_edges(want[1], build.complete(some, got[1].columns))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_neighbors_read_edges_once(spark):
    nodes, edges = chain(spark, 9)
    nodes = nodes.withColumn("label", F.col("id")).withColumn("type", F.lit("concept")).withColumn("path", F.lit(None).cast("string")).withColumn("normalized_label", F.col("id"))
    loop = edges.limit(1).withColumn("source", F.lit("n005")).withColumn("target", F.lit("n005"))
    found = search.neighbors(nodes, edges.unionByName(loop), "n005")
    assert sorted((r.id, r.direction) for r in found.collect()) == [("n004", "outgoing"), ("n005", "outgoing"), ("n005", "outgoing"), ("n006", "incoming")]
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert search.neighbors(nodes, edges, "nowhere").count() == 0


def test_all_rows_of_a_page_name_it(spark, tmp_path):
    """alias_map is equal to its SQL where a page is there more than once, with other titles."""
    pages = [(1, "https://a.example/1", "<title>First one</title>"), (1, "https://a.example/2", "<title>Second one</title>"), (2, "https://a.example/2", "<title>First two</title>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, Q.alias_map(spark, str(tmp_path)).collect())) == sorted(duckdb.sql(Q.ORACLES["alias_map"]).fetchall())


def test_plain_text_is_not_searched_for_marks(monkeypatch):
    """Most texts have no marks, and no address begins where there is no '@'."""
    monkeypatch.setattr(markdown, "_TOKEN", None)
    assert markdown.inline("plain words.  \nmore\\ of (them)!") == ("plain words.more\\ of (them)!", [])
    assert markdown.inline("*em* [x](u) `c` www.a.de") == ("em x c www.a.de", [("u", 1), ("http://www.a.de", 1)])
    monkeypatch.setattr(markdown, "_ITEM", None)
    assert not markdown._starts_block("  plain")
