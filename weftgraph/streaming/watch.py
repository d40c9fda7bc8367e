"""Keeping a graph up to date from streams, by Structured Streaming and foreachBatch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import artifacts as art
from ..plans.graph import Graph, Options, Result, build_graph, load_result, save_graph, update_graph
from ..plans.storage import shared_folder
from ..schema import ARTIFACTS
from ..sources.items import EXTENSIONS, local_files

DEBOUNCE_MS = 250
OUTPUT = "weftgraph-out"


def build_output(spark: SparkSession, source, options: Options | None = None, folder: str = OUTPUT, clean_wiki: bool = True) -> Result:
    """build_graph, and all nine renderings under folder."""
    options = options or Options(artifacts=ARTIFACTS)
    result = build_graph(spark, source, options)
    art.write_artifacts(result.artifacts, folder, clean_wiki)
    return result


def watch_folder(spark: SparkSession, root: str, folder: str = OUTPUT, options: Options | None = None, debounce_ms: int = DEBOUNCE_MS, on_result: Callable[[Result], None] | None = None, once: bool = False) -> StreamingQuery:
    """Build a folder's graph anew whenever files come or change; the trigger interval takes the
    place of a debounce. With once, what is there is handled and the query ends."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(EXTENSIONS) + "}").load(root)

    def rebuild(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            result = build_output(batch.sparkSession, local_files(batch.sparkSession, root), options, folder)
            if on_result:
                on_result(result)

    writer = files.select("path").writeStream.foreachBatch(rebuild).option("checkpointLocation", f"{shared_folder(spark)}/watch-{hashlib.sha256(repr((root, folder)).encode()).hexdigest()[:32]}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()


def follow(changes: DataFrame, path: str, checkpoint: str, options: Options | None = None, once: bool = False, trigger: str = "10 seconds") -> StreamingQuery:
    """Apply a stream of changes(id, text, ..., deleted boolean, changed_at) to the graph saved at path.

    Of several changes to an item in a batch the last wins. The graph of batch n is written as
    version n, so a batch that runs twice starts from the same version and gives the same."""

    def apply(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "id"]
        last = batch.groupBy("id").agg(F.max_by(F.struct(*rest), "changed_at").alias("p")).select("id", "p.*").cache()
        try:
            gone = last.where("deleted").select(F.col("id").alias("source_item_id"))
            new = last.where("not coalesce(deleted, false)").drop("deleted", "changed_at")
            save_graph(update_graph(current(batch.sparkSession, path, number), new, gone, options).graph, f"{path}/v{number + 1}")
        finally:
            last.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def current(spark: SparkSession, path: str, version: int) -> Graph:
    return load_result(spark, f"{path}/v{version}").graph
