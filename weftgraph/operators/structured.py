"""Walking JSON and a small YAML dialect into schema nodes. Runs in Python workers."""

from __future__ import annotations

import json
import math
import re

from ..functions import text as X

MAX_DEPTH = 5
MAX_NODES = 250
_REFERENCE = re.compile(r"(?:https?://|\./|\.\./|/|[\w-]+[.][\w-]+(?:/|$))", re.A)
_LINE = re.compile(r"(?P<indent>\s*)(?:-\s*)?(?P<key>[^#:][^:]*):(?P<value>.*)$")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)$", re.A)


def scalar(value: str):
    """A YAML scalar: one quote sign is cut from each end; then literal, number or string."""
    s = re.sub(r"['\"]$", "", re.sub(r"^['\"]", "", value))
    if s in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[s]
    t = s.strip()
    if _NUMBER.match(t):
        n = float(t)
        return (int(n) if n.is_integer() and abs(n) < 1e15 else n) if math.isfinite(n) else s
    if re.match(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$", t):
        return int(t, 0)
    return 0 if s and not t else s


def simple_yaml(text: str) -> dict:
    """Nested maps by indentation. Lists of scalars vanish, maps in a list share their keys; never fails."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for raw in re.split(r"\r?\n", text):
        if not raw.strip() or raw.strip().startswith("#"):
            continue
        m = _LINE.match(raw)
        if not m:
            continue
        indent, key, value = len(m["indent"]), m["key"].strip(), m["value"].strip()
        while len(stack) > 1 and indent <= stack[-1][0]:
            stack.pop()
        if value:
            stack[-1][1][key] = scalar(value)
        else:
            child: dict = {}
            stack[-1][1][key] = child
            stack.append((indent, child))
    return root


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {list: "array", str: "string", dict: "object"}.get(type(v), "number")


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def walk(item: dict, document: dict) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of a JSON or YAML item below its document node."""
    doc, nodes, edges, seen = document["id"], [document], [], set()
    path = (item.get("path") or "").replace("\\", "/")

    def edge(source: str, target: str, relation: str, context: str, confidence: str = "EXTRACTED", score: float = 1.0) -> None:
        edges.append({"source": source, "target": target, "relation": relation, "confidence": confidence, "confidence_score": score, "source_item_id": item["id"], "context": context})

    try:
        value = json.loads(item["text"], parse_constant=_no_number) if path.lower().endswith(".json") else simple_yaml(item["text"])
    except ValueError as e:
        nodes.append({"id": f"{doc}:parse_error", "label": "Parse Error", "type": "schema_error", "source_item_id": item["id"], "path": path, "metadata": json.dumps({"message": str(e), "path": path}, sort_keys=True)})
        edge(doc, f"{doc}:parse_error", "contains", "schema_parse", "AMBIGUOUS", 0.2)
        return nodes, edges

    def add(node: str, label: str, kind: str, parent: str, v) -> None:
        if node not in seen:
            seen.add(node)
            about = {"path": path, "valueType": _kind(v)}
            if not isinstance(v, dict):
                about["sample"] = f"array({len(v)})" if isinstance(v, list) else v
            nodes.append({"id": node, "label": X.py_sanitize_label(label), "type": kind, "source_item_id": item["id"], "path": path, "metadata": json.dumps(about, sort_keys=True, ensure_ascii=False)})
        edge(parent, node, "contains", "schema")

    def visit(v, at: list[str], parent: str, depth: int) -> None:
        if depth > MAX_DEPTH or len(nodes) > MAX_NODES:
            return
        if isinstance(v, list):
            node = f"{doc}:schema:{X.py_slugify('.'.join(at))}"
            add(node, at[-1] if at else "array", "schema_array", parent, len(v))
            sample = next((x for x in v if isinstance(x, (dict, list))), v[0] if v else ...)
            if sample is not ...:
                visit(sample, [*at, "item"], node, depth + 1)
        elif isinstance(v, dict):
            for key, child in v.items():
                node = f"{doc}:schema:{X.py_slugify('.'.join([*at, key]))}"
                add(node, key, {list: "schema_array", dict: "schema_object"}.get(type(child), "schema_field"), parent, child)
                visit(child, [*at, key], node, depth + 1)
        elif isinstance(v, str) and _REFERENCE.match(v):
            node = f"resource:{X.py_slugify(v)}"
            if node not in seen:
                seen.add(node)
                nodes.append({"id": node, "label": X.py_sanitize_label(v), "type": "resource", "source_item_id": item["id"], "href": v, "metadata": json.dumps({"href": v}, ensure_ascii=False)})
            edge(parent, node, "references", "schema_value")

    visit(value, [], doc, 0)
    return nodes, edges
