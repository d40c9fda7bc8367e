"""Renderings of a graph: JSON, report, wiki, HTML, timeline, manifest, DOT, GraphML and Cypher.

Lines of the graph formats are made by Spark and can be written by it; the functions that return strings
collect a graph and are for graphs that a reader can look at."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import history
from .storage import numbered

LABELS = 8
WIKI_MEMBERS = 25
FILES = {"json": "graph.json", "report": "GRAPH_REPORT.md", "html": "graph.html", "timeline": "timeline.json", "manifest": "manifest.json", "dot": "graph.dot", "graphml": "graph.graphml", "cypher": "graph.cypher"}
WIKI_FOLDER = "wiki"


def snake(name: str) -> str:
    return re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name)


def camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), name)


def json_string(c: Column) -> Column:
    """c as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)


def dot_id(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), F.lit('"'))


def escape_xml(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def cypher_relation(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", "_")), F.lit("")), F.lit("RELATED_TO"))


def _lines(nodes: DataFrame, node_line: Column, edges: DataFrame, edge_line: Column) -> DataFrame:
    """(part, ord, line): nodes before edges."""
    return nodes.select(F.lit(1).alias("part"), "ord", node_line.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), "ord", edge_line.alias("line")))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _lines(nodes, F.concat(F.lit("  "), dot_id(F.col("id")), F.lit(" [label="), json_string(F.col("label")), F.lit("];")), edges, F.concat(F.lit("  "), dot_id(F.col("source")), F.lit(" -> "), dot_id(F.col("target")), F.lit(" [label="), json_string(F.col("relation")), F.lit("];")))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    node = F.concat(F.lit("MERGE (n:GraphNode {id: "), json_string(F.col("id")), F.lit("}) SET n.label = "), json_string(F.col("label")), F.lit(", n.type = "), json_string(F.col("type")), F.lit(";"))
    edge = F.concat(F.lit("MATCH (a:GraphNode {id: "), json_string(F.col("source")), F.lit("}), (b:GraphNode {id: "), json_string(F.col("target")), F.lit("}) MERGE (a)-[:"), cypher_relation(F.col("relation")), F.lit(" {confidence: "), json_string(F.col("confidence")), F.lit("}]->(b);"))
    return _lines(nodes, node, edges, edge)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def x(c: str) -> Column:
        return escape_xml(F.coalesce(c, F.lit("")))

    def data(key: str, c: str) -> Column:
        return F.concat(F.lit(f'<data key="{key}">'), x(c), F.lit("</data>"))

    node = F.concat(F.lit('    <node id="'), x("id"), F.lit('">'), data("label", "label"), data("type", "type"), F.lit("</node>"))
    edge = F.concat(F.lit('    <edge id="e'), F.col("index").cast("string"), F.lit('" source="'), x("source"), F.lit('" target="'), x("target"), F.lit('">'), data("relation", "relation"), data("confidence", "confidence"), F.lit("</edge>"))
    return _lines(nodes, node, numbered(edges.select("ord", "source", "target", "relation", "confidence"), "ord"), edge)


def _text(head: list[str], lines: DataFrame, tail: list[str] = []) -> str:  # noqa: B006
    return "\n".join([*head, *(r.line for r in lines.orderBy("part", "ord").collect()), *tail])


def dot(graph) -> str:
    settings = {"graph": "rankdir=LR", "node": "shape=box"}
    return _text(["digraph Graph {", *(f"  {k} [{v}];" for k, v in settings.items())], dot_lines(graph.nodes, graph.edges), ["}"])


def graphml(graph) -> str:
    def opening(name: str, **attributes: str) -> str:
        return f"<{name} " + " ".join(f'{k}="{v}"' for k, v in attributes.items()) + ("?>" if name[0] == "?" else ">")

    head = [opening("?xml", version="1.0", encoding="UTF-8"), opening("graphml", xmlns="http://graphml.graphdrawing.org/xmlns"), "  " + opening("graph", id="Graph", edgedefault="directed")]
    return _text(head, graphml_lines(graph.nodes, graph.edges), ["  </graph>", "</graphml>"])


def cypher(graph) -> str:
    return _text(["// Cypher export of a graph"], cypher_lines(graph.nodes, graph.edges))


def manifest_sources(nodes: DataFrame) -> DataFrame:
    """(source_item_id, node_count, labels, hash, updated_at): the first labels of each source, hash
    and time of its first node, be they null."""
    own = nodes.where("source_item_id <> ''")
    place = F.row_number().over(W.partitionBy("source_item_id").orderBy("ord"))
    return own.withColumn("_k", place).groupBy("source_item_id").agg(F.count("*").alias("node_count"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= LABELS, F.struct("_k", "label")))), lambda x: x["label"]).alias("labels"), F.min_by("hash", "_k").alias("hash"), F.min_by("updated_at", "_k").alias("updated_at"))


def plain(row) -> dict:
    """A row as JSON has it: camel case, nulls left out, metadata as an object."""
    out = {}
    for k, v in (row.asDict() if hasattr(row, "asDict") else row).items():
        if v is None or k in ("ord", "_pos", "path", "href", "hash", "updated_at") and "relation" not in row and k != "hash":
            continue
        if k == "metadata":
            v = json.loads(v)
        out[camel(k)] = {camel(a): b for a, b in v.asDict().items() if b is not None} if hasattr(v, "asDict") else v
    return out


def _rows(df: DataFrame | None, order: str | None = None) -> list[dict]:
    return [] if df is None else [plain(r) for r in (df.orderBy(order) if order else df).collect()]


def _node_rows(graph) -> list[dict]:
    return [{k: v for k, v in plain(r).items() if k != "hash"} for r in graph.nodes.orderBy("ord").collect()]


def changes_of(graph) -> dict | None:
    if graph.changes is None:
        return None
    names = {"added_node": "addedNodes", "removed_node": "removedNodes", "changed_node": "changedNodes", "added_edge": "addedEdges", "removed_edge": "removedEdges", "changed_source": "changedSourceItemIds"}
    lists: dict[str, list] = {v: [] for v in names.values()}
    for r in graph.changes.orderBy("kind", "key").collect():
        lists[names[r["kind"]]].append(r["key"])
    return {"timestamp": graph.updated_at, **lists, "summary": {camel(k): v for k, v in history.summary(graph.changes).first().asDict().items()}}


def _stats(graph, communities: int | None = None) -> dict:
    out = {camel(k): v for k, v in graph.stats.first().asDict().items()}
    return out | ({} if communities is None else {"communityCount": communities}) | {"snapshotCount": graph.snapshots.count(), "timelineEventCount": graph.timeline.count()}


def to_json(graph, communities: int | None = None, spaces: int = 2) -> str:
    body = {"version": graph.version, "createdAt": graph.created_at, "updatedAt": graph.updated_at, "nodes": _node_rows(graph), "edges": _rows(graph.edges, "ord")}
    if graph.hyperedges is not None:
        body["hyperedges"] = _rows(graph.hyperedges, "ord")
    body |= {"timeline": _rows(graph.timeline), "snapshots": _rows(graph.snapshots)}
    if (changes := changes_of(graph)) is not None:
        body["changes"] = changes
    return json.dumps(body | {"stats": _stats(graph, communities)}, indent=spaces, ensure_ascii=False)


def report(graph, analysis) -> str:
    stats = graph.stats.first()
    groups = analysis.communities.orderBy("community").select("label", "size").collect()
    out = ["# Graph Report", "", f"- {stats.node_count} nodes", f"- {stats.edge_count} edges", f"- {len(groups)} communities", f"- {graph.timeline.count()} timeline events", "", "## God Nodes"]
    out += [f"- {r.label} ({r.degree})" for r in analysis.god_nodes.collect()]
    out += ["", "## Confidence Breakdown", *(f"- {r.confidence}: {r.n}" for r in analysis.confidence_breakdown.collect())]
    found = analysis.surprising_connections.orderBy("rank").collect()
    out += ["", "## Surprising Connections", *([] if found else ["- None"])]
    for r in found:
        out += [f"- {r.source} --{r.relation}--> {r.target} [{r.confidence}]", f"  {r.reason}"]
    out += ["", "## Communities", *(f"- {r.label} ({r.size} nodes)" for r in groups)]
    if graph.changes is not None:
        s = history.summary(graph.changes).first()
        names = ("Added nodes", "Removed nodes", "Changed nodes", "Added edges", "Removed edges", "Changed sources")
        out += ["", "## Latest Change Set", *(f"- {n}: {v}" for n, v in zip(names, s))]
    return "\n".join(out)


def timeline(graph) -> str:
    body = {"createdAt": graph.created_at, "updatedAt": graph.updated_at, "snapshots": _rows(graph.snapshots), "timeline": _rows(graph.timeline)}
    if (changes := changes_of(graph)) is not None:
        body["latestChanges"] = changes
    return json.dumps(body, indent=2, ensure_ascii=False)


def manifest(graph, communities: int | None = None) -> str:
    sources = [{camel(k): v for k, v in r.asDict().items() if v is not None} for r in manifest_sources(graph.nodes).orderBy("source_item_id").collect()]
    return json.dumps({"version": graph.version, "createdAt": graph.created_at, "updatedAt": graph.updated_at, "stats": _stats(graph, communities), "sources": sources}, indent=2, ensure_ascii=False)


def wiki_members(nodes: DataFrame) -> DataFrame:
    """(community, rank, label, type) of the first members of each community."""
    rank = F.row_number().over(W.partitionBy("community").orderBy("ord"))
    return nodes.withColumn("rank", rank).where(F.col("rank") <= WIKI_MEMBERS).select("community", "rank", "label", "type")


def wiki(graph, analysis) -> dict[str, str]:
    stats = graph.stats.first()
    groups = analysis.communities.orderBy("community").select("community", "label").collect()
    pages: dict[int, list[str]] = {}
    for r in wiki_members(graph.nodes).orderBy("community", "rank").collect():
        pages.setdefault(r.community, []).append(f"- {r.label} ({r.type})")
    out = {"index.md": "\n".join(["# Graph Wiki", "", f"- Nodes: {stats.node_count}", f"- Edges: {stats.edge_count}", "", "## Communities", *(f"- [[community-{g.community}.md|{g.label}]]" for g in groups)])}
    return out | {f"community-{g.community}.md": "\n".join([f"# {g.label}", "", *pages.get(g.community, [])]) for g in groups}


_PAGE = """<!doctype html>
<html><meta charset=utf-8><title>Graph</title>
<style>
body { margin: 0; background: #101418; color: #dde; font: 13px sans-serif }
canvas { display: block }
form { position: fixed; left: 8px; top: 8px }
</style>
<form onsubmit="return false"><input id=find placeholder="Find a node"> <span id=told></span></form><canvas id=view></canvas>
<script>
// A force layout of its own: springs along edges, repulsion through a grid, drawn on a canvas.
const data = __DATA__, view = document.getElementById("view"), pen = view.getContext("2d");
const place = new Map(data.nodes.map((n, i) => [n.id, i])), top_ = Math.max(1e-9, ...Object.values(data.pageRank));
const dots = data.nodes.map((n, i) => ({...n, x: 300 * Math.cos(i * 2.4) * Math.sqrt(i + 1) / 9, y: 300 * Math.sin(i * 2.4) * Math.sqrt(i + 1) / 9, degree: 0}));
const ties = data.edges.map(e => ({...e, a: dots[place.get(e.source)], b: dots[place.get(e.target)]}));
for (const t of ties) { t.a.degree++; t.b.degree++; }
const radius = n => data.pageRank[n.id] === undefined ? 3 + Math.sqrt(n.degree) : 3 + 12 * Math.sqrt(data.pageRank[n.id] / top_);
const hue = n => `hsl(${(n.community || 0) * 67 % 360} 60% 60%)`, dash = {EXTRACTED: [], INFERRED: [5, 4], AMBIGUOUS: [1, 4]};
let zoom = 1, panX = 0, panY = 0, query = "", heat = 1, held = null;
function push(p, dx, dy) { p.vx = (p.vx || 0) * 0.85 + dx * heat; p.vy = (p.vy || 0) * 0.85 + dy * heat; }
function step() {
  const cells = new Map(), key = (x, y) => Math.floor(x / 80) + "," + Math.floor(y / 80);
  for (const p of dots) { const k = key(p.x, p.y); cells.has(k) ? cells.get(k).push(p) : cells.set(k, [p]); }
  for (const p of dots) {
    let dx = -p.x / 400, dy = -p.y / 400;
    for (let i = -1; i < 2; i++) for (let j = -1; j < 2; j++) for (const q of cells.get(key(p.x + 80 * i, p.y + 80 * j)) || []) if (q !== p) {
      const u = p.x - q.x, v = p.y - q.y, d = u * u + v * v + 1;
      dx += 40 * u / d; dy += 40 * v / d;
    }
    push(p, dx, dy);
  }
  for (const t of ties) if (t.a !== t.b) {
    const u = t.b.x - t.a.x, v = t.b.y - t.a.y, d = Math.hypot(u, v) + 0.1, f = (d - 60) / d / 25;
    push(t.a, u * f, v * f); push(t.b, -u * f, -v * f);
  }
  for (const p of dots) { p.x += p.vx || 0; p.y += p.vy || 0; }
  heat *= 0.99;
}
function draw() {
  if (heat > 0.02) step();
  view.width = innerWidth; view.height = innerHeight;
  pen.setTransform(zoom, 0, 0, zoom, innerWidth / 2 + panX, innerHeight / 2 + panY);
  pen.strokeStyle = "#567";
  for (const t of ties) { pen.lineWidth = 0.4 + 1.2 * t.confidenceScore; pen.setLineDash(dash[t.confidence] || []); pen.beginPath(); pen.moveTo(t.a.x, t.a.y); pen.lineTo(t.b.x, t.b.y); pen.stroke(); }
  for (const p of dots) {
    pen.globalAlpha = !query || p.label.toLowerCase().includes(query) ? 1 : 0.12;
    pen.fillStyle = hue(p); pen.beginPath(); pen.arc(p.x, p.y, radius(p), 0, 7); pen.fill();
    if (zoom > 0.7) { pen.fillStyle = "#dde"; pen.fillText(p.label.slice(0, 40), p.x + radius(p) + 2, p.y + 3); }
  }
  pen.globalAlpha = 1;
  requestAnimationFrame(draw);
}
document.getElementById("find").oninput = e => query = e.target.value.toLowerCase();
view.onwheel = e => { zoom *= e.deltaY < 0 ? 1.1 : 0.9; e.preventDefault(); };
view.onmousedown = e => held = e; onmouseup = () => held = null;
view.onmousemove = e => {
  if (held) { panX += e.movementX; panY += e.movementY; return; }
  const x = (e.clientX - innerWidth / 2 - panX) / zoom, y = (e.clientY - innerHeight / 2 - panY) / zoom;
  const at = dots.find(p => Math.hypot(p.x - x, p.y - y) < radius(p) + 2);
  document.getElementById("told").textContent = at ? `${at.label} (${at.type}), ${at.degree} edges, community ${at.community}` : "";
};
draw();
</script>
"""


def html(graph, analysis=None) -> str:
    nodes = [{camel(k): v for k, v in r.asDict().items() if v is not None} for r in graph.nodes.orderBy("ord").select("id", "label", "type", "community", "source_item_id", "merged_from").collect()]
    edges = [{camel(k): v for k, v in r.asDict().items()} for r in graph.edges.orderBy("ord").select("source", "target", "relation", "confidence", F.coalesce("confidence_score", F.lit(0.5)).alias("confidence_score")).collect()]
    ranks = {r.id: r["rank"] for r in analysis.page_rank.collect()} if analysis else {}
    body = json.dumps({"nodes": nodes, "edges": edges, "pageRank": ranks}, ensure_ascii=False)
    return _PAGE.replace("__DATA__", re.sub("</script>", r"<\\/script>", body, flags=re.I))


def render(graph, analysis, kinds: Iterable[str] = ("json", "report")) -> dict:
    count = analysis.communities.count()
    makers = {"json": lambda: to_json(graph, count), "report": lambda: report(graph, analysis), "wiki": lambda: wiki(graph, analysis), "html": lambda: html(graph, analysis), "timeline": lambda: timeline(graph), "manifest": lambda: manifest(graph, count), "dot": lambda: dot(graph), "graphml": lambda: graphml(graph), "cypher": lambda: cypher(graph)}
    return {k: makers[k]() for k in makers if k in set(kinds)}


def write_artifacts(made: dict, folder: str, clean_wiki: bool = True) -> list[str]:
    """The renderings as files under folder on the driver's disk; returns their paths."""
    os.makedirs(folder, exist_ok=True)
    out = []

    def put(name: str, body: str) -> None:
        # a page name can't leave the folder
        path = os.path.join(folder, *(re.sub(r"\.\.", "_", p) for p in name.split("/") if p))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
        out.append(path)

    for kind, name in FILES.items():
        if kind in made:
            put(name, made[kind])
    if "wiki" in made:
        old = os.path.join(folder, WIKI_FOLDER)
        if clean_wiki and os.path.isdir(old):
            for name in os.listdir(old):
                if name.endswith(".md"):
                    os.remove(os.path.join(old, name))
        for name, body in made["wiki"].items():
            put(f"{WIKI_FOLDER}/{name}", body)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of a large graph as text files of one folder, in order over the files' names."""
    lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.mode("overwrite").text(path)
