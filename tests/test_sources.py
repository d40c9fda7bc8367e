from weftgraph.operators import facts
from weftgraph.plans.graph import Options, build_graph, update_from_changes
from weftgraph.sources import items as sources
from weftgraph.sources.datasource import provider_source, read_provider


class Notes:
    def list(self):
        return [3, 1, 2]

    def read(self, n):
        one = {"id": f"note{n}", "text": f"# Note {n}", "updated_at": f"2024-01-0{n}"}
        return [one, one | {"id": f"copy{n}"}] if n == 2 else one

    def changes_after(self, cursor):
        new = [n for n in self.list() if n > (cursor or 0)]
        return new, max([cursor or 0, *new])


def test_a_provider_is_read_in_partitions(spark):
    df = read_provider(spark, Notes(), "notes_batch", 2)
    assert sorted(r.id for r in df.collect()) == ["copy2", "note1", "note2", "note3"]
    assert build_graph(spark, df).graph.nodes.where("type = 'document'").count() == 4


def test_a_provider_is_streamed(spark, tmp_path):
    spark.dataSource.register(provider_source(Notes(), "notes_stream"))
    seen = []
    q = spark.readStream.format("notes_stream").load().writeStream.foreachBatch(lambda df, n: seen.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["copy2", "note1", "note2", "note3"]


def test_fact_and_converted_providers(spark):
    f = spark.createDataFrame([("k1", "v1", "2024-01-01"), ("k2", "v2", "2024-02-01")], "key string, value string, last_updated_at string")
    provider, options = facts.FactProvider(f), Options(extractor=facts.extract_facts, extractor_on_frames=True)
    first = build_graph(spark, provider, options)
    assert first.graph.nodes.where("type = 'memory_fact'").count() == 2
    later = update_from_changes(first, provider, "2024-01-15", options)
    assert [r.source_item_id for r in later.graph.timeline.where("event = 'updated'").collect()] == ["memory:k2"]
    records = spark.createDataFrame([("1", "text of one")], "id string, input string")
    r = build_graph(spark, sources.ConvertedProvider(records, lambda s: "# " + s.upper()))
    assert r.node("text of one").first().type == "heading"


def test_index_and_whole_result(spark):
    import json

    r = build_graph(spark, [{"id": "a", "text": "# A\n\nbody"}])
    assert r.index["edges_by_node_id"].count() == 2 * r.graph.edges.count()
    body = json.loads(r.to_json())
    assert set(body) == {"graph", "analysis", "artifacts", "diagnostics"} and body["analysis"]["communities"][0]["size"] == 3
