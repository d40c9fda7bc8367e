import os

from weftgraph.plans.graph import Options, build_graph, load_result, save_graph
from weftgraph.streaming.watch import build_output, follow, watch_folder


def test_changes_are_applied_in_order(spark, tmp_path):
    start = build_graph(spark, [{"id": "a", "text": "# First"}, {"id": "b", "text": "# Second"}])
    save_graph(start.graph, str(tmp_path / "g/v0"))
    schema = "id string, text string, title string, deleted boolean, changed_at int"
    spark.createDataFrame([("a", "# Old", "old", False, 1), ("a", "# New", "new", False, 2), ("b", None, None, True, 3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "g"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    now = load_result(spark, str(tmp_path / "g/v1"))
    assert {r.source_item_id for r in now.graph.nodes.collect()} == {"a"}
    assert now.node("new").count() == 1 and now.search("old").count() == 0
    assert {r.event for r in now.graph.timeline.collect()} == {"added", "updated", "removed"}


def test_watching_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Watched")
    seen = []
    watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), Options(artifacts=("json", "dot")), on_result=seen.append, once=True).awaitTermination(120)
    assert len(seen) == 1 and os.path.exists(tmp_path / "out/graph.dot")


def test_output_has_all_renderings(spark, tmp_path):
    build_output(spark, [{"id": "a", "text": "# A"}], folder=str(tmp_path / "o"))
    assert len(os.listdir(tmp_path / "o")) == 9
