"""The engine's front door: build a graph from items, query it, update it, save and load it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze, build, extract, history
from ..operators import search as finding
from ..schema import EDGE_COLUMNS, HYPEREDGE, NODE_COLUMNS
from ..sources import items as sources
from . import artifacts as art
from .storage import stored

VERSION = "0.1.0"

#: (spark, items, nodes, edges) -> a fragment
Enricher = Callable[[SparkSession, DataFrame, DataFrame, DataFrame], "Fragment"]


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


@dataclass
class Fragment:
    """What an enricher adds: tables without ord, and notes for the diagnostics."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    hyperedges: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    usage: dict | None = None


#: Warnings and errors that reach the driver, each in their own order
REPORTED = 1000


@dataclass
class Diagnostics:
    warnings: list[str] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    skipped_items: list[str] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)
    model_usage: list[dict] = field(default_factory=list)
    #: How many there are; warnings and errors above hold the first REPORTED of each, the tables below all
    warning_count: int = 0
    error_count: int = 0
    all_warnings: DataFrame | None = None
    all_errors: DataFrame | None = None


@dataclass
class Options:
    allow: Column | Callable[[dict], bool] | None = None
    extractor: extract.Extractor | Callable[[DataFrame], DataFrame] | None = None
    #: Whether extractor takes and returns a DataFrame instead of one item.
    extractor_on_frames: bool = False
    enricher: Enricher | None = None
    entity_resolution: bool = False
    artifacts: tuple[str, ...] = ("json", "report")
    fix_extension_alias: bool = False
    #: Partitions in which items are extracted; None leaves that to the plan.
    concurrency: int | None = None
    mode: str = "PERMISSIVE"
    timestamp: str | None = None


@dataclass
class Analysis:
    """Each member is a DataFrame made when asked for."""

    nodes: DataFrame
    edges: DataFrame
    #: (community, label, size); the members of each are the nodes of that community
    communities: DataFrame
    top_n: int = analyze.TOP_N

    @cached_property
    def god_nodes(self) -> DataFrame:
        return analyze.god_nodes(self.nodes, self.edges, self.top_n)

    @cached_property
    def isolated_nodes(self) -> DataFrame:
        return analyze.isolated_nodes(self.nodes, self.edges)

    @cached_property
    def confidence_breakdown(self) -> DataFrame:
        return analyze.confidence_breakdown(self.edges)

    @cached_property
    def surprising_connections(self) -> DataFrame:
        return analyze.surprising_connections(self.nodes, self.edges)

    @cached_property
    def page_rank(self) -> DataFrame:
        return analyze.page_rank(self.nodes, self.edges)

    @cached_property
    def betweenness(self) -> DataFrame | None:
        return analyze.betweenness(self.nodes, self.edges)

    @cached_property
    def bridge_nodes(self) -> DataFrame:
        return analyze.bridge_nodes(self.nodes, self.edges)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    created_at: str
    updated_at: str
    timeline: DataFrame
    snapshots: DataFrame
    hyperedges: DataFrame | None = None
    changes: DataFrame | None = None
    version: str = VERSION

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def stats(self) -> DataFrame:
        return build.stats(self.nodes, self.edges)

    def last_epoch(self) -> int:
        tops = [df.agg(F.max("ord.epoch").alias("e")).first().e for df in (self.nodes, self.edges)]
        return max((t for t in tops if t is not None), default=-1)


@dataclass
class Result:
    graph: Graph
    analysis: Analysis
    diagnostics: Diagnostics
    options: Options

    @cached_property
    def artifacts(self) -> dict:
        """The renderings asked for; JSON and the report are always among them."""
        return art.render(self.graph, self.analysis, tuple(dict.fromkeys(("json", "report", *self.options.artifacts))))

    @cached_property
    def index(self) -> dict[str, DataFrame]:
        return finding.index(self.graph.nodes, self.graph.edges)

    def to_json(self, spaces: int = 2) -> str:
        """Graph, analysis, renderings and diagnostics as one object that load_result reads."""
        a = self.analysis
        parts = {"god_nodes": a.god_nodes, "isolated_nodes": a.isolated_nodes, "surprising_connections": a.surprising_connections.orderBy("rank"), "communities": analyze.with_node_ids(a.communities, a.nodes, a.nodes.select("id", "community")).orderBy("community"), "bridge_nodes": a.bridge_nodes, "page_rank": a.page_rank, "confidence_breakdown": a.confidence_breakdown}
        analysis = {art.camel(k): [{art.camel(x): y for x, y in r.asDict().items()} for r in df.collect()] for k, df in parts.items()}
        about = {art.camel(k): v for k, v in vars(self.diagnostics).items() if not k.startswith("all_")}
        return json.dumps({"graph": json.loads(self.artifacts["json"]), "analysis": analysis, "artifacts": self.artifacts, "diagnostics": about}, indent=spaces, ensure_ascii=False)

    def search(self, query: str) -> DataFrame:
        return finding.score_nodes(self.graph.nodes, query)

    def node(self, query: str) -> DataFrame:
        return finding.get_node(self.graph.nodes, query)

    def query(self, query: str, depth: int = finding.DEPTH, max_seeds: int = finding.MAX_SEEDS) -> tuple[DataFrame, DataFrame]:
        return finding.query_graph(self.graph.nodes, self.graph.edges, query, depth, max_seeds)

    def path(self, source: str, target: str) -> tuple[list[str], list[dict], float] | None:
        return finding.shortest_path(self.graph.nodes, self.graph.edges, source, target)

    def neighbors(self, query: str) -> DataFrame:
        return finding.neighbors(self.graph.nodes, self.graph.edges, query)

    def community(self, number: int) -> DataFrame:
        return finding.community_nodes(self.graph.nodes, number)

    def timeline(self, source_item_id: str | None = None) -> DataFrame:
        t = self.graph.timeline
        return t if source_item_id is None else t.where(F.col("source_item_id") == source_item_id)

    def changes(self) -> DataFrame | None:
        return self.graph.changes


def _timed(diagnostics: Diagnostics, name: str, since: float) -> None:
    diagnostics.timings[name] = (time.time() - since) * 1000


def _extracted(items: DataFrame, options: Options, diagnostics: Diagnostics) -> DataFrame:
    if options.concurrency:
        items = items.repartition(options.concurrency)
    if options.extractor_on_frames:
        rows = options.extractor(items)
    else:
        rows = extract.extract(items, options.extractor)
    rows = stored(rows, "extracted")
    every = extract.errors(rows)
    failed = [r.asDict() for r in every.orderBy("item_id", "error").limit(REPORTED).collect()]  # the first of a report
    diagnostics.error_count += every.count() if len(failed) == REPORTED else len(failed)
    diagnostics.all_errors = every
    if failed and options.mode == "FAILFAST":
        raise ValueError(f"{failed[0]['item_id']}: {failed[0]['error']}")
    diagnostics.errors += failed
    return rows


def _enriched(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None, items: DataFrame, options: Options, diagnostics: Diagnostics, epoch: int) -> tuple:
    since = time.time()
    spark = items.sparkSession
    f = options.enricher(spark, items, nodes, edges)

    def placed(df: DataFrame | None) -> DataFrame | None:
        return None if df is None or "ord" in df.columns else df.withColumn("ord", build.ord_of(F.lit(0), F.monotonically_increasing_id(), epoch))

    hyper = f.hyperedges
    if hyper is not None and "ord" not in hyper.columns:
        hyper = hyper.withColumn("ord", F.monotonically_increasing_id())
    new_nodes, new_edges = (stored(x, "fragment") if (x := placed(df)) is not None else None for df in (f.nodes, f.edges))
    out = build.merge_fragment(nodes, edges, hyperedges, new_nodes, new_edges, hyper)
    diagnostics.warnings += f.warnings
    diagnostics.model_usage += [f.usage] if f.usage else []
    _timed(diagnostics, "semantic", since)
    return out


def _finished(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    members, groups = analyze.community_members(nodes, edges)
    return stored(analyze.assign_communities(nodes, members), "nodes"), edges, hyperedges, stored(groups, "communities")


def _validated(nodes: DataFrame, edges: DataFrame, diagnostics: Diagnostics) -> None:
    every = stored(build.validate(nodes, edges).select("message"), "warnings")
    first = [r.message for r in every.orderBy("message").limit(REPORTED).collect()]
    diagnostics.warnings += first
    diagnostics.warning_count += every.count() if len(first) == REPORTED else len(first)
    diagnostics.all_warnings = every


def build_graph(spark: SparkSession, source, options: Options | None = None, order: str | None = None) -> Result:
    """Items from source, their nodes and edges, and the graph of them all."""
    options = options or Options()
    diagnostics, stamp, since = Diagnostics(), options.timestamp or now(), time.time()
    items = stored(sources.collect_items(spark, source, options.allow, order), "items")
    _timed(diagnostics, "collect", since)
    since = time.time()
    rows = _extracted(items, options, diagnostics)
    _timed(diagnostics, "extract", since)
    since = time.time()
    nodes, edges = build.build(*build.raw_tables(rows), options.fix_extension_alias)
    edges = stored(edges, "edges")
    # the first snapshot is of the graph as built, before entities are resolved
    snapshots = history.snapshot(nodes, edges, "build", stamp)
    timeline = history.initial_timeline(items, rows, stamp)
    _timed(diagnostics, "build", since)
    hyperedges = None
    if options.entity_resolution:
        nodes, edges = build.resolve_entities(nodes, edges)
    if options.enricher:
        nodes, edges, hyperedges = _enriched(nodes, edges, hyperedges, items, options, diagnostics, build.BEHIND * 2)
    nodes, edges, hyperedges, groups = _finished(nodes, edges, hyperedges)
    _validated(nodes, edges, diagnostics)
    graph = Graph(nodes, edges, stamp, stamp, stored(timeline, "timeline"), stored(snapshots, "snapshots"), hyperedges)
    return Result(graph, Analysis(nodes, edges, groups), diagnostics, options)


def update_graph(previous: Graph | Result, upsert=None, delete: list[str] | DataFrame = (), options: Options | None = None) -> Result:
    """The graph after items are put in or replaced and sources are deleted. Upserts are not filtered
    by `allow`; a source that is both upserted and deleted is there again afterwards."""
    old = previous.graph if isinstance(previous, Result) else previous
    options = options or Options()
    spark, diagnostics, stamp = old.spark, Diagnostics(), options.timestamp or now()
    since = time.time()
    items = stored(sources.collect_items(spark, [] if upsert is None else upsert), "items")
    deleted = delete if isinstance(delete, DataFrame) else spark.createDataFrame([(x,) for x in delete], "source_item_id string")
    rows = _extracted(items, options, diagnostics)
    _timed(diagnostics, "extract", since)
    since = time.time()
    fragment = build.build(*build.raw_tables(rows, old.last_epoch() + 1), options.fix_extension_alias)
    affected = deleted.unionByName(items.select(F.col("id").alias("source_item_id")))
    nodes, edges, hyperedges = build.update(old.nodes, old.edges, old.hyperedges, fragment, affected, options.fix_extension_alias)
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    _timed(diagnostics, "build", since)
    if options.enricher and not items.isEmpty():
        nodes, edges, hyperedges = _enriched(nodes, edges, hyperedges, items, options, diagnostics, old.last_epoch() + build.BEHIND)
    nodes, edges, hyperedges, groups = _finished(nodes, edges, hyperedges)
    _validated(nodes, edges, diagnostics)
    changes = stored(history.diff(old.nodes, old.edges, nodes, edges), "changes")
    timeline = old.timeline.unionByName(history.update_timeline(old.nodes, items, deleted, stamp))
    snapshots = old.snapshots.unionByName(history.snapshot(nodes, edges, "update", stamp, groups.count()))
    graph = replace(old, nodes=nodes, edges=edges, hyperedges=hyperedges, updated_at=stamp, timeline=stored(timeline, "timeline"), snapshots=stored(snapshots, "snapshots"), changes=changes)
    return Result(graph, Analysis(nodes, edges, groups), diagnostics, options)


def update_from_changes(previous: Graph | Result, provider, cursor: str | None, options: Options | None = None) -> Result:
    """update_graph with what a provider says has changed since cursor, as far as it is allowed."""
    options = options or Options()
    spark = (previous.graph if isinstance(previous, Result) else previous).spark
    return update_graph(previous, sources.changed_items(spark, provider, cursor, options.allow), (), options)


_PARTS = ("nodes", "edges", "timeline", "snapshots", "hyperedges", "changes")


def save_graph(graph: Graph, path: str) -> None:
    """The graph as Parquet tables under path."""
    for name in _PARTS:
        df = getattr(graph, name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    about = [(graph.version, graph.created_at, graph.updated_at, ",".join(n for n in _PARTS if getattr(graph, n) is not None))]
    graph.spark.createDataFrame(about, "version string, created_at string, updated_at string, parts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_result(spark: SparkSession, path: str, options: Options | None = None) -> Result:
    """A saved graph, analysed anew; path may also be a JSON file as the json artifact has it."""
    if path.endswith(".json"):
        graph = _from_json(spark, path)
    else:
        about = spark.read.parquet(f"{path}/about").first()
        parts = {n: spark.read.parquet(f"{path}/{n}") for n in about.parts.split(",")}
        graph = Graph(parts["nodes"], parts["edges"], about.created_at, about.updated_at, parts["timeline"], parts["snapshots"], parts.get("hyperedges"), parts.get("changes"), about.version)
    members, groups = analyze.community_members(graph.nodes, graph.edges)
    nodes, groups = stored(analyze.assign_communities(graph.nodes, members), "nodes"), stored(groups, "communities")
    graph = replace(graph, nodes=nodes)
    return Result(graph, Analysis(nodes, graph.edges, groups), Diagnostics(), options or Options())


def _from_json(spark: SparkSession, path: str) -> Graph:
    """A graph, or an object that wraps one as `graph`."""
    node = "id string, label string, type string, sourceItemId string, sourceUrl string, sourceLocation string, normalizedLabel string, mergedFrom array<string>, community int, metadata string"
    edge = "source string, target string, relation string, confidence string, confidenceScore double, sourceItemId string, sourceLocation string, context string, metadata string"
    hyper = "id string, label string, nodes array<string>, metadata string"
    entry = "id string, timestamp string, event string, sourceItemId string, label string, hash string, previousHash string, nodeIds array<string>, metadata string"
    snap = "id string, timestamp string, label string, nodeCount bigint, edgeCount bigint, sourceCount bigint, communityCount bigint, sourceHashes map<string,string>"

    def typed(ddl: str) -> str:
        return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in ddl.split(", "))

    body = f"version string, createdAt string, updatedAt string, nodes array<struct<{typed(node)}>>, edges array<struct<{typed(edge)}>>, hyperedges array<struct<{typed(hyper)}>>, timeline array<struct<{typed(entry)}>>, snapshots array<struct<{typed(snap)}>>"
    raw = spark.read.schema(f"{body}, graph struct<{typed_body(body)}>").json(path, multiLine=True)
    names = [f.name for f in raw.schema if f.name != "graph"]
    one = stored(raw.select(*[F.coalesce(F.col(n), F.col(f"graph.{n}")).alias(n) for n in names]), "loaded")

    def table(name: str) -> DataFrame:
        df = one.select(F.posexplode(name).alias("_pos", "_x")).select("_pos", "_x.*")
        return df.select("_pos", *[F.col(c).alias(art.snake(c)) for c in df.columns if c != "_pos"])

    def about(key: str) -> Column:
        return F.get_json_object("metadata", f"$.{key}")

    place = build.ord_of(F.lit(0), F.col("_pos"))
    nodes = table("nodes").withColumns({"ord": place, "path": about("path"), "href": about("href"), "hash": about("hash"), "updated_at": about("updatedAt")})
    edges = table("edges").withColumn("ord", place)
    head = one.first()
    hyperedges = table("hyperedges").withColumn("ord", F.col("_pos").cast("bigint")).select(*[c.split()[0] for c in HYPEREDGE.split(", ")])
    return Graph(stored(build.complete(nodes, NODE_COLUMNS), "nodes"), stored(build.complete(edges, EDGE_COLUMNS), "edges"), head.createdAt, head.updatedAt, table("timeline").drop("_pos"), table("snapshots").drop("_pos"), hyperedges, None, head.version or VERSION)


def typed_body(ddl: str) -> str:
    """Top-level fields of a schema as those of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))
