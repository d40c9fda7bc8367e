"""From items to extraction rows: one row an item with arrays of nodes and edges.

Documents, scripts and data files are parsed in Python workers, each item for itself, in one narrow
stage. An item that fails gives its error in a column; nothing else is lost by it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..schema import EXTRACTION
from . import markdown, script, structured

CODE = (".js", ".cjs", ".mjs", ".jsx", ".ts", ".cts", ".mts", ".tsx")
DATA = (".json", ".yml", ".yaml")
#: Estimated bytes of tables whose rows are spread before they are parsed.
SPREAD = (1 << 16, 1 << 30)
_TAG = re.compile(r"(?:^|\s)#([\w-]+)")

Extractor = Callable[[dict], tuple[list[dict], list[dict]]]


def _extension(path: str | None) -> str:
    last = (path or "").replace("\\", "/").split("/")[-1]
    return last[last.rindex(".") :].lower() if "." in last else ""


def front_matter(text: str) -> tuple[dict, str]:
    """(the map between the '---' lines at the start, the rest)"""
    m = re.match(r"\ufeff?---[ \t]*\r?\n(.*?)(?:^---[ \t]*(?:\r?\n|$)|\Z)", text, re.S | re.M)
    if not m:
        return {}, text
    try:
        import yaml
    except ImportError:
        data = structured.simple_yaml(m[1])
    else:
        data = yaml.safe_load(m[1])
    return (_keyed(data) if isinstance(data, dict) else {}), text[m.end() :]


def _keyed(value):
    """Maps have strings as keys, whatever YAML reads there."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else "null" if k is None else str(k).lower() if isinstance(k, bool) else str(k): _keyed(v) for k, v in value.items()}
    return [_keyed(v) for v in value] if isinstance(value, list) else value


def inline_tags(text: str) -> list[str]:
    return _TAG.findall(text)


def document_node(item: dict, kind: str, matter: dict | None = None) -> dict:
    path = item["path"].replace("\\", "/") if item.get("path") else item.get("path")
    base = next((p for p in reversed((path or "").split("/")) if p), None)
    title = (matter or {}).get("title")
    if title is None:
        title = next((x for x in (item.get("title"), base, item.get("url"), item["id"]) if x is not None), "")
    about = json.loads(item["metadata"]) if item.get("metadata") else {}
    about |= {"frontmatter": matter or {}, "hash": item.get("hash"), "updatedAt": item.get("updated_at"), "mimeType": item.get("mime_type"), "path": path, "sourceType": item.get("source_type")}
    about = {k: v for k, v in about.items() if v is not None}
    return {"id": f"doc:{item['id']}", "label": X.py_sanitize_label(str(title)), "type": kind, "source_item_id": item["id"], "source_url": item.get("url"), "path": path, "href": about.get("href"), "hash": item.get("hash"), "updated_at": item.get("updated_at"), "metadata": json.dumps(X.py_sanitize_value(about), sort_keys=True, ensure_ascii=False, default=str), "storage_ref": item.get("storage_ref")}


def extract_markdown(item: dict) -> tuple[list[dict], list[dict]]:
    matter, body = front_matter(item["text"] or "")
    doc = document_node(item, "document", matter)
    path, id_ = doc["path"], item["id"]
    nodes, edges = [doc], []

    def edge(source: str, target: str, relation: str, context: str, line: int | None, confidence: str = "EXTRACTED", metadata: str | None = None) -> None:
        edges.append({"source": source, "target": target, "relation": relation, "confidence": confidence, "source_item_id": id_, "source_location": f"L{line}" if line else None, "context": context, "metadata": metadata})

    def add_tag(owner: str, tag: str, line: int | None = None) -> None:
        value = X.py_sanitize_label(re.sub("^#", "", tag))
        if value:
            node = f"tag:{X.py_slugify(value)}"
            nodes.append({"id": node, "label": value, "type": "tag", "source_item_id": id_, "metadata": json.dumps({"tag": value}, ensure_ascii=False)})
            edge(owner, node, "tagged_with", "tag", line)

    def add_links(owner: str, links: list[tuple[str, int]]) -> None:
        for url, line in links:
            href = X.py_sanitize_label(url)
            if href:
                node, about = f"resource:{X.py_slugify(href)}", json.dumps({"href": href}, ensure_ascii=False)
                nodes.append({"id": node, "label": href, "type": "resource", "source_item_id": id_, "href": href, "metadata": about})
                edge(owner, node, "links_to", "markdown_link", line, metadata=about)

    tags = matter.get("tags")
    for tag in tags if isinstance(tags, list) else [t.strip() for t in tags.split(",") if t.strip()] if isinstance(tags, str) else []:
        add_tag(doc["id"], str(tag))
    above: list[tuple[int, str]] = []
    n_headings = n_chunks = 0
    for block in markdown.blocks(body):
        label = X.py_sanitize_label(block.text)
        if not label:
            continue
        if block.kind == "heading":
            node = f"{doc['id']}:heading:{n_headings}:{X.py_slugify(label)}"
            n_headings += 1
            while above and above[-1][0] >= block.depth:
                above.pop()
            about, kind, context, shown = {"depth": block.depth, "path": path}, "heading", "heading", label
        else:
            node = f"{doc['id']}:chunk:{n_chunks}"
            n_chunks += 1
            about, kind, context, shown = {"text": label, "path": path, "blockType": block.kind}, "chunk", block.kind, label[:120]
        parent = above[-1][1] if above else doc["id"]
        nodes.append({"id": node, "label": shown, "type": kind, "source_item_id": id_, "source_location": f"L{block.line}", "path": path, "metadata": json.dumps({k: v for k, v in about.items() if v is not None}, sort_keys=True, ensure_ascii=False)})
        edge(parent, node, "contains", context, block.line)
        add_links(node, block.links)
        for tag in inline_tags(label):
            add_tag(node, tag, block.line)
        if kind == "heading":
            above.append((block.depth, node))
    if item.get("parent_id"):
        edge(f"doc:{item['parent_id']}", doc["id"], "contains", "parent_id", None, "INFERRED")
    return nodes, edges


def extract_item(item: dict) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of one item, by the kind of file that its path names."""
    item = item | {"text": X.py_sanitize_text(item.get("text"))}
    kind = _extension(item.get("path"))
    if kind in CODE:
        return script.extract(item, document_node(item, "code_file"))
    if kind in DATA:
        return structured.walk(item, document_node(item, "data_file"))
    return extract_markdown(item)


def spread(items: DataFrame) -> DataFrame:
    """items over all cores, if their table is a small one: a few files of short rows are one task otherwise,
    however long these take to parse. Tables from SPREAD[1] bytes on are read in many parts anyway."""
    size = int(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if not SPREAD[0] <= size < SPREAD[1]:
        return items
    spark = items.sparkSession
    return items.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "id")


def extract(items: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Extraction rows of items; extractor replaces extract_item."""
    run_one = extractor or extract_item
    schema = to_arrow_schema(StructType.fromDDL(EXTRACTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.to_pylist():
                try:
                    nodes, edges = run_one(item)
                    error = None
                except Exception as e:  # noqa: BLE001 - one bad item must not fail the rest
                    nodes, edges, error = [], [], f"{type(e).__name__}: {e}"
                rows.append({"item_seq": item["item_seq"], "item_id": item["id"], "nodes": nodes, "edges": edges, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(items).mapInArrow(run, EXTRACTION)


def errors(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("error").isNotNull()).select("item_id", "error")
