"""The engine end to end, on graphs that can be checked by eye or by brute force."""

import json
import os
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import analyze, build, facts, history, search
from weftgraph.plans import artifacts as art
from weftgraph.plans.graph import Fragment, Options, build_graph, load_result, save_graph, update_from_changes, update_graph
from weftgraph.sources import items as sources
from weftgraph.sources.enrich import chat_enricher, parse_fragment

PAIR = [{"id": "1", "title": "Overview", "path": "docs/overview.md", "text": "# Overview\n\nSee [the guide](guide.md) #start"}, {"id": "2", "title": "Guide", "path": "docs/guide.md", "text": "# Guide\n\nBody of the guide"}]
T0, T1 = "2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z"


def toy(spark, n_nodes, pairs, **more):
    """A graph of nodes v0.. and edges between numbers."""
    nodes = spark.createDataFrame([(i, f"v{i:03d}", f"Node {i}", more.get("types", {}).get(i, "document"), f"s{i % 3}") for i in range(n_nodes)], "k int, id string, label string, type string, source_item_id string")
    nodes = build.complete(nodes.withColumn("ord", build.ord_of(F.lit(0), F.col("k"))), build.NODE_COLUMNS)
    rows = [(k, f"v{a:03d}", f"v{b:03d}", "r", "EXTRACTED", w) for k, (a, b, w) in enumerate((*p, None)[:3] for p in pairs)]
    edges = spark.createDataFrame(rows, "k int, source string, target string, relation string, confidence string, confidence_score double")
    return nodes, build.complete(edges.withColumn("ord", build.ord_of(F.lit(1), F.col("k"))), build.EDGE_COLUMNS)


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.fixture(scope="module")
def pair(spark):
    return build_graph(spark, PAIR, Options(timestamp=T0, artifacts=art.FILES.keys() | {"wiki"}))


def edge_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_records_become_a_graph(pair):
    assert pair.graph.stats.first().source_count == 2
    assert ("doc:1:chunk:0", "doc:2", "references", "INFERRED") in edge_set(pair.graph.edges, "source", "target", "relation", "confidence")
    ids, edges, weight = pair.path("Overview", "Guide")
    assert ids[0].startswith("doc:1") and ids[-1].startswith("doc:2") and len(edges) == len(ids) - 1 and weight > 0
    assert pair.diagnostics.warnings == [] and set(pair.diagnostics.timings) == {"collect", "extract", "build"}
    assert pair.graph.timeline.count() == 2 and pair.graph.snapshots.first().community_count == 0


def test_every_edge_end_is_a_node_and_degrees_add_up(pair):
    ids = {r.id for r in pair.graph.nodes.collect()}
    ends = edge_set(pair.graph.edges, "source", "target")
    assert {x for e in ends for x in e} <= ids
    assert analyze.degrees(pair.graph.nodes, pair.graph.edges).agg(F.sum("degree")).first()[0] == 2 * pair.graph.edges.count()


def test_artifacts(pair, tmp_path):
    made = pair.artifacts
    assert set(made) == set(art.FILES) | {"wiki"}
    body = json.loads(made["json"])
    assert len(body["nodes"]) == body["stats"]["nodeCount"] and body["nodes"][0]["id"] == "doc:1" and body["nodes"][0]["normalizedLabel"] == "overview"
    assert made["report"].startswith("# Graph Report") and "## Communities" in made["report"] and "## Latest Change Set" not in made["report"]
    assert made["dot"].splitlines()[0] == "digraph Graph {" and made["graphml"].count("<edge ") == pair.graph.edges.count()
    assert "<canvas" in made["html"] and "pageRank" in made["html"] and "__DATA__" not in made["html"]
    assert [s["sourceItemId"] for s in json.loads(made["manifest"])["sources"]] == ["1", "2"]
    folder = str(tmp_path / "out")
    paths = art.write_artifacts(made | {"wiki": made["wiki"] | {"../../evil.md": "x"}}, folder)
    assert all(os.path.realpath(p).startswith(folder) for p in paths) and os.path.exists(f"{folder}/wiki/index.md")
    art.write_artifacts(made, folder)
    assert not any("evil" in n for n in os.listdir(f"{folder}/wiki"))


def test_save_and_load(spark, pair, tmp_path):
    save_graph(pair.graph, str(tmp_path / "g"))
    again = load_result(spark, str(tmp_path / "g"))
    assert edge_set(again.graph.edges, "source", "target", "relation") == edge_set(pair.graph.edges, "source", "target", "relation")
    for name, body in (("a.json", pair.artifacts["json"]), ("b.json", json.dumps({"graph": json.loads(pair.artifacts["json"]), "analysis": {}, "diagnostics": {}}))):
        (tmp_path / name).write_text(body)
        back = load_result(spark, str(tmp_path / name))
        assert edge_set(back.graph.nodes, "id", "label", "path", "href") == edge_set(pair.graph.nodes, "id", "label", "path", "href")
        assert history.diff(pair.graph.nodes.drop("metadata", "storage_ref"), pair.graph.edges, back.graph.nodes.drop("metadata", "storage_ref"), back.graph.edges).count() == 0


def test_providers_and_permission(spark):
    class Provider:
        def read(self, spark):
            return sources.from_records(spark, PAIR)

    only = build_graph(spark, Provider(), Options(allow=F.col("id") == "2", concurrency=3))
    assert edge_set(only.graph.nodes.where("type = 'document'"), "id") == {("doc:2",)}
    some = sources.collect_items(spark, PAIR, lambda item: item["title"] == "Guide")
    assert [r.id for r in some.collect()] == ["2"]
    with pytest.raises(TypeError):
        sources.collect_items(spark, 5)


def test_changes_honour_the_cursor(spark, pair):
    class Feed(sources.TableProvider):
        def read(self, spark):
            return sources.from_records(spark, [PAIR[0] | {"updated_at": "2024-01-01"}, {"id": "3", "title": "New", "text": "# New", "updated_at": "2024-03-01"}])

    new = update_from_changes(pair, Feed("", {}), "2024-02-01", Options(timestamp=T1))
    assert edge_set(new.timeline("3"), "event", "source_item_id") == {("added", "3")}
    assert new.graph.timeline.count() == 3


def test_update_and_delete(spark, pair):
    new = update_graph(pair, [{"id": "2", "title": "Manual", "path": "docs/manual.md", "text": "# Manual", "hash": "h2"}], ["1"], Options(timestamp=T1))
    assert edge_set(new.graph.nodes, "source_item_id") == {("2",)}
    assert new.search("guide").count() == 0 and new.node("manual").first().id == "doc:2"
    assert edge_set(new.graph.timeline.where(f"timestamp = '{T1}'"), "event", "source_item_id") == {("updated", "2"), ("removed", "1")}
    assert new.graph.snapshots.count() == 2 and "1" in {r.key for r in new.changes().where("kind = 'changed_source'").collect()}
    assert "## Latest Change Set" in new.artifacts["report"]
    both = update_graph(pair, [PAIR[0]], ["1"], Options(timestamp=T1))
    assert {"updated", "removed"} == {r.event for r in both.timeline("1").where(f"timestamp = '{T1}'").collect()} and both.node("overview").count() == 1


def test_empty_update_changes_nothing(pair):
    same = update_graph(pair, None, [], Options(timestamp=T1))
    assert same.changes().count() == 0
    assert edge_set(same.graph.edges, "source", "target", "relation", "context") == edge_set(pair.graph.edges, "source", "target", "relation", "context")


def test_deleting_a_source_takes_shared_nodes_it_gave_last(spark):
    g = build_graph(spark, [{"id": "a", "text": "x #shared"}, {"id": "b", "text": "y #shared"}])
    after = update_graph(g, None, ["b"])
    assert after.graph.nodes.where("id = 'tag:shared'").count() == 0  # the tag was b's, by the last to name it


def test_custom_extractor_and_errors(spark):
    def one(item):
        if item["id"] == "2":
            raise ValueError("bad item")
        return [{"id": "n:" + item["id"], "label": item["title"], "type": "thing", "source_item_id": item["id"]}], []

    r = build_graph(spark, PAIR, Options(extractor=one))
    assert r.node("overview").first().type == "thing"
    assert [(e["item_id"], "bad item" in e["error"]) for e in r.diagnostics.errors] == [("2", True)]
    with pytest.raises(ValueError, match="bad item"):
        build_graph(spark, PAIR, Options(extractor=one, mode="FAILFAST"))


def test_memory_facts(spark):
    f = spark.createDataFrame([("team", "Contact", "Mail a@b.org, see https://x.org/p and /workspace/n.md on 2024-05-06 in own/repo", [" Ops ", "ops", ""], True)], "scope string, key string, value string, tags array<string>, obsolete boolean")
    items = facts.fact_items(f)
    assert items.first().id == "memory:team:Contact" and items.first().text.endswith("Tags: ops\n\nKind: semantic")
    r = build_graph(spark, items, Options(extractor=facts.extract_facts, extractor_on_frames=True))
    got = edge_set(r.graph.edges, "relation", "target")
    assert {("tagged_with", "tag:ops"), ("mentions", "email:a-b-org"), ("mentions_date", "date:2024-05-06"), ("references_file", "file_ref:workspace-n-md"), ("references_repository", "repository:own-repo"), ("links_to", "resource:https-x-org-p"), ("classified_as", "fact_kind:semantic")} <= got
    assert r.graph.nodes.where("id = 'fact:memory:team:Contact'").first().type == "obsolete_memory_fact"
    assert r.graph.nodes.where("type = 'tag'").first().source_item_id is None


def test_entities_of_several_sources_merge(spark):
    code = "export function shared() { return only(); }\nfunction only() {}\n"
    r = build_graph(spark, [{"id": "a", "path": "a.ts", "text": code}, {"id": "b", "path": "b.ts", "text": code.replace("only", "other")}], Options(entity_resolution=True))
    row = r.graph.nodes.where("label = 'shared'").collect()
    assert len(row) == 1 and row[0].merged_from == ["doc:a:symbol:shared", "doc:b:symbol:shared"]
    assert ("doc:a:symbol:shared", "doc:b:symbol:other", "calls") in edge_set(r.graph.edges, "source", "target", "relation")


def test_enricher(spark):
    asked = {}

    def transport(url, headers, body):
        asked.update(url=url, body=json.loads(body))
        answer = {"nodes": [{"id": "concept:x", "label": "X\x00"}], "edges": [{"source": "doc:1", "target": "concept:x", "confidenceScore": 0.7}, {"source": "doc:1", "target": "nowhere"}], "hyperedges": [{"id": "h", "label": "both", "nodes": ["doc:1", "doc:2", "gone"]}, {"id": "h2", "nodes": ["doc:1"]}]}
        return 200, json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps(answer) + "\n```"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7}})

    r = build_graph(spark, PAIR, Options(enricher=chat_enricher("http://h/v1/", "k", "m", transport)))
    assert asked["url"] == "http://h/v1/chat/completions" and asked["body"]["temperature"] == 0
    assert ("doc:1", "concept:x", "semantic_relation", "INFERRED", "semantic_llm") in edge_set(r.graph.edges, "source", "target", "relation", "confidence", "context")
    assert r.graph.nodes.where("id = 'concept:x'").first().label == "X"
    assert [(h.id, h.nodes) for h in r.graph.hyperedges.collect()] == [("h", ["doc:1", "doc:2"])]
    assert r.diagnostics.model_usage[0]["totalTokens"] == 7
    assert parse_fragment("no json")[1] and parse_fragment("no json")[0]["nodes"] == []
    with pytest.raises(RuntimeError):
        build_graph(spark, PAIR, Options(enricher=chat_enricher("http://h", "k", "m", lambda *a: (500, ""))))


def test_fragment_nodes_keep_the_old_place(spark, pair):
    new = spark.createDataFrame([("doc:1", "Renamed", "document")], "id string, label string, type string")
    r = build_graph(spark, PAIR, Options(enricher=lambda *a: Fragment(nodes=new)))
    first = r.graph.nodes.orderBy("ord").first()
    assert (first.id, first.label) == ("doc:1", "Renamed")


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in {"one.md": "# One", "sub/two words.md": "# Two\n\n[x](one.md)", "node_modules/no.md": "no", "skip.md": "no", ".hidden.md": "no", "pic.png": "no", ".weftgraphignore": "skip.md\n# note\n"}.items():
        (tmp_path / name).write_text(text)
    r = build_graph(spark, str(tmp_path))
    assert {x.source_item_id for x in r.graph.nodes.collect()} == {"one.md", "sub/two words.md"}
    ids, _, _ = r.path("Two", "One")
    assert len(ids) > 1
    row = r.graph.nodes.where("id = 'doc:one.md'").first()
    assert row.hash and row.updated_at.endswith("Z") and row.storage_ref.provider == "local"


@pytest.mark.parametrize("path, patterns, want", [("a/b.md", ["a/"], True), ("a.md", ["a/"], False), ("x/dist/y", ["dist"], True), ("a/b", ["/b"], False), ("b/c", ["/b"], True), ("a/x.log", ["*.log", "!x.log"], False), ("a/b/c.md", ["a/**/c.md"], True)])
def test_ignore_patterns(path, patterns, want):
    assert sources.ignored(path, patterns) == want


def test_converted_records(spark):
    records = spark.createDataFrame([("1", "a,b")], "id string, input string")
    assert sources.converted(records, lambda s: "# " + s.upper()).first().text == "# A,B"


# -- building --


def test_last_payload_first_place_and_first_edge(spark):
    nodes = spark.createDataFrame([(0, "a", "A1", "document", None), (1, "b", "B", "document", "s"), (2, "a", "A2", "document", "t")], "k int, id string, label string, type string, source_item_id string").withColumn("ord", build.ord_of(F.lit(0), F.col("k")))
    edges = spark.createDataFrame([(0, "a", "b", "r", "AMBIGUOUS", None), (1, "a", "b", "r", "EXTRACTED", ""), (2, "a", "zz", "r", "EXTRACTED", None), (3, "a", "b", "r", "EXTRACTED", "s")], "k int, source string, target string, relation string, confidence string, source_item_id string").withColumn("ord", build.ord_of(F.lit(0), F.col("k")))
    n, e = build.build(nodes, edges)
    assert [(r.id, r.label) for r in n.orderBy("ord").collect()] == [("a", "A2"), ("b", "B")]
    assert [(r.confidence, r.source_item_id) for r in e.orderBy("ord").collect()] == [("AMBIGUOUS", None), ("EXTRACTED", "s")]


def test_aliases(spark):
    items = [{"id": "g", "path": "docs/guide.md", "text": "x"}, {"id": "i", "path": "docs/api/index.md", "text": "x"}]
    links = ["guideguide", "guide", "guide.md#part", "docs/api", "guide.md"]
    items.append({"id": "l", "text": "\n\n".join(f"[t]({x})" for x in links)})
    to = lambda r: {(e.source[-1], e.target) for e in r.graph.edges.where(build.is_inferred_reference()).collect()}
    assert to(build_graph(spark, items)) == {("0", "doc:g"), ("3", "doc:i"), ("4", "doc:g")}
    assert to(build_graph(spark, items, Options(fix_extension_alias=True))) == {("1", "doc:g"), ("3", "doc:i"), ("4", "doc:g")}


def test_validation_messages(spark):
    nodes, edges = toy(spark, 2, [(0, 1), (0, 5)])
    nodes = nodes.withColumn("label", F.when(F.col("id") == "v001", "").otherwise(F.col("label")))
    assert {r.message for r in build.validate(nodes, edges).collect()} == {"Node v001 missing label.", "Edge target 'v005' does not match any node."}


def test_hyperedges_lose_or_keep_members(spark):
    nodes, edges = toy(spark, 3, [(0, 1)])
    hyper = spark.createDataFrame([(0, "h", "H", ["v000", "v002"], None), (1, "k", "K", ["v000", "v001"], None)], "ord bigint, id string, label string, nodes array<string>, metadata string")
    left = build.without_sources(nodes, edges, hyper, spark.createDataFrame([("s2",), ("",)], "source_item_id string"))
    assert [r.id for r in left[2].collect()] == ["k"]


# -- analytics --


def brute_components(n, pairs):
    parent = list(range(n))
    for _ in range(n):
        for a, b, *_ in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return parent


@pytest.mark.parametrize("seed, n, m", [(1, 40, 30), (2, 60, 25), (3, 5, 0)])
def test_components_are_a_partition(spark, seed, n, m):
    pairs = random_pairs(seed, n, m) + ([(i, i + 1) for i in range(20, 38)] if n > 38 else [])
    nodes, edges = toy(spark, n, pairs)
    assert {r.id: r.root for r in analyze.components(nodes, edges).collect()} == {f"v{i:03d}": f"v{c:03d}" for i, c in enumerate(brute_components(n, pairs))}
    groups = analyze.communities(nodes, edges).orderBy("community").collect()
    assert sum(g["size"] for g in groups) == n and [g["size"] for g in groups] == sorted((g["size"] for g in groups), reverse=True)
    assert sorted(x for g in groups for x in g.node_ids) == [f"v{i:03d}" for i in range(n)]


def test_community_labels(spark):
    nodes, edges = toy(spark, 4, [(0, 1), (2, 3)], types={0: "tag", 2: "tag", 3: "resource"})
    assert [(r.label, r["size"]) for r in analyze.communities(nodes, edges).orderBy("community").collect()] == [("Node 1", 2), ("Community", 2)]


def brute_rank(n, pairs, steps=30):
    out = Counter(a for a, _ in pairs)
    rank = [1 / n] * n
    for _ in range(steps):
        new = [0.15 / n] * n
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("limit", [10**6, 0])
def test_page_rank(spark, limit):
    pairs = random_pairs(4, 25, 60) + [(1, 1), (2, 3), (2, 3)]
    nodes, edges = toy(spark, 25, pairs)
    got = {r.id: r["rank"] for r in analyze.page_rank(nodes, edges, one_task_edges=limit).collect()}
    want = brute_rank(25, pairs)
    assert all(abs(got[f"v{i:03d}"] - w) < 1e-12 for i, w in enumerate(want)) and sum(got.values()) <= 1 + 1e-9


def brute_betweenness(n, pairs):
    near = defaultdict(list)
    for a, b in pairs:
        if a != b:
            near[a].append(b)
            near[b].append(a)

    def paths(s):
        dist, count, todo = {s: 0}, Counter({s: 1}), [s]
        for v in todo:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        return dist, count

    all_ = [paths(s) for s in range(n)]
    out = [0.0] * n
    for s, t in product(range(n), repeat=2):
        for v in range(n):
            if len({s, t, v}) == 3 and t in all_[s][0] and v in all_[s][0] and t in all_[v][0] and all_[s][0][v] + all_[v][0][t] == all_[s][0][t]:
                out[v] += all_[s][1][v] * all_[v][1][t] / all_[s][1][t]
    return [x * 2 / ((n - 1) * (n - 2)) for x in out]


def test_betweenness(spark):
    pairs = random_pairs(5, 14, 20) + [(0, 1), (0, 1), (3, 3)]
    nodes, edges = toy(spark, 14, pairs)
    got = {r.id: r.betweenness for r in analyze.betweenness(nodes, edges).collect()}
    assert all(abs(got[f"v{i:03d}"] - w) < 1e-9 for i, w in enumerate(brute_betweenness(14, pairs)))
    assert analyze.betweenness(nodes, edges, limit=13) is None


@pytest.mark.parametrize("seed", range(4))
def test_cut_vertices(seed):
    n = 18
    pairs = random_pairs(seed, n, 20)
    parts = lambda gone: len(set(brute_components(n, [p for p in pairs if gone not in p]))) - (gone is not None)
    alone = {i for i in range(n) if all(i not in p or p[0] == p[1] for p in pairs)}
    want = {i for i in range(n) if i not in alone and parts(i) > parts(None)}
    assert set(analyze.articulation_points(list(range(n)), pairs)) == want


def test_cut_vertices_of_a_long_chain(spark):
    nodes, edges = toy(spark, 3000, [(i, i + 1) for i in range(2999)])
    assert len(analyze.articulation_points([f"v{i:03d}" for i in range(3000)], [tuple(r) for r in edges.select("source", "target").collect()])) == 2998
    small, links = toy(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 5)])
    assert [(r.id, r.degree) for r in analyze.bridge_nodes(small, links).collect()] == [("v002", 3)]


def test_rankings_are_stable(spark):
    nodes, edges = toy(spark, 5, [(0, 1), (2, 3), (4, 4)], types={0: "tag"})
    assert [(r.id, r.degree) for r in analyze.god_nodes(nodes, edges).collect()] == [("v004", 2), ("v001", 1), ("v002", 1), ("v003", 1)]
    assert {r.id for r in analyze.isolated_nodes(nodes, edges).collect()} == {"v001", "v002", "v003"}
    assert [(r.confidence, r.n) for r in analyze.confidence_breakdown(edges).collect()] == [("EXTRACTED", 3), ("INFERRED", 0), ("AMBIGUOUS", 0)]
    assert [r["rank"] for r in analyze.surprising_connections(nodes, edges).orderBy("rank").collect()] == [1, 2]


# -- search --


def test_scores(spark):
    rows = [(0, "a", "Graph", "document", "docs/graph.md"), (1, "b", "Graph theory", "chunk", None), (2, "c", "The graph", "tag", None), (3, "d", "Other", "class", "x/graph.ts"), (4, "e", "None", "class", None)]
    nodes = spark.createDataFrame(rows, "k int, id string, label string, type string, path string").withColumn("ord", build.ord_of(F.lit(0), F.col("k")))
    nodes = build.complete(nodes, build.NODE_COLUMNS)
    assert {r.id: r.score for r in search.score_nodes(nodes, "GRAPH!").collect()} == {"a": 109, "b": 50, "c": 8, "d": 8}
    assert {r.id: r.score for r in search.score_nodes(nodes, "graph theory graph").collect()}["b"] == 50 + 10 + 50
    assert search.get_node(nodes, "graph").first().id == "a"
    assert search.score_nodes(nodes, " !").count() == 0


def test_hops_stop_before_the_last_level(spark):
    nodes, edges = toy(spark, 6, [(0, 1), (2, 1), (2, 3), (1, 2), (3, 4), (2, 5), (3, 5)])
    around, touched = search.k_hop(nodes, edges, nodes.where("id = 'v000'"), 2)
    assert {(r.id, r.hop) for r in around.collect()} == {("v000", 0), ("v001", 1), ("v002", 2)}
    assert edge_set(touched, "source", "target") == {("v000", "v001"), ("v002", "v001"), ("v001", "v002")}


def test_neighbours_and_loops(spark):
    nodes, edges = toy(spark, 3, [(0, 1), (2, 0), (0, 0)])
    assert sorted((r.id, r.direction) for r in search.neighbors(nodes, edges, "node 0").collect()) == [("v000", "outgoing"), ("v000", "outgoing"), ("v001", "outgoing"), ("v002", "incoming")]


def test_cheapest_ways(spark):
    rng = random.Random(8)
    pairs = [(a, b, rng.choice([None, 0.1, 0.5, 1.0])) for a, b in random_pairs(8, 20, 35)]
    nodes, edges = toy(spark, 20, pairs)
    cost = [float("inf")] * 20
    cost[0] = 0.0
    for _ in range(20):
        for a, b, w in pairs:
            step = 1 / max(0.5 if w is None else w, 0.01)
            cost[b], cost[a] = min(cost[b], cost[a] + step), min(cost[a], cost[b] + step)
    got = {r.id: r.cost for r in search.distances(edges, nodes.where("id = 'v000'")).collect()}
    assert all(abs(got[f"v{i:03d}"] - c) < 1e-9 if c < float("inf") else f"v{i:03d}" not in got for i, c in enumerate(cost))
    far = max((c, i) for i, c in enumerate(cost) if c < float("inf"))
    ids, used, total = search.shortest_path(nodes.withColumn("label", F.concat(F.lit("n"), F.col("ord.pos"), F.lit("z"))).withColumn("normalized_label", F.col("label")), edges, "n0z", f"n{far[1]}z")
    assert abs(total - far[0]) < 1e-9 and ids[0] == "v000" and ids[-1] == f"v{far[1]:03d}" and len(used) == len(ids) - 1
    assert search.shortest_path(nodes, edges, "nowhere", "node") is None


# -- history --


def test_diff(spark):
    nodes, edges = toy(spark, 3, [(0, 1)])
    assert history.diff(nodes, edges, nodes, edges).count() == 0
    moved = nodes.where("id <> 'v002'").withColumn("community", F.when(F.col("id") == "v000", 7))
    more = edges.withColumn("context", F.lit("c"))
    changes = history.diff(nodes, edges, moved, more)
    assert {(r.kind, r.key) for r in changes.collect()} == {("changed_node", "v000"), ("removed_node", "v002"), ("changed_source", "s0"), ("changed_source", "s2"), ("removed_edge", "v000:v001:r::"), ("added_edge", "v000:v001:r::c")}
    assert history.summary(changes).first().asDict() == {"added_node_count": 0, "removed_node_count": 1, "changed_node_count": 1, "added_edge_count": 1, "removed_edge_count": 1, "changed_source_count": 2}


def test_manifest_takes_the_first_node_even_if_null(spark):
    nodes, _ = toy(spark, 6, [])
    nodes = nodes.withColumn("hash", F.when(F.col("id") > "v002", F.col("id")))
    assert {r.source_item_id: r.hash for r in art.manifest_sources(nodes).collect()} == {"s0": None, "s1": None, "s2": None}
    assert {r.source_item_id: r.hash for r in history.source_hashes(nodes).collect()} == {"s0": "v003", "s1": "v004", "s2": "v005"}


def test_escapes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(art.escape_xml(F.lit("<a & 'b\">"))) == "&lt;a &amp; &apos;b&quot;&gt;"
    assert one(art.json_string(F.lit('q"\\\n'))) == '"q\\"\\\\\\n"'
    assert one(art.dot_id(F.lit("a:b-c"))) == '"a_b_c"'
    assert one(art.cypher_relation(F.lit("is part-of"))) == "IS_PART_OF" and one(art.cypher_relation(F.lit(""))) == "RELATED_TO"
