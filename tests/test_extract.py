"""Parsers on texts by hand."""

import json
import time

from weftgraph.operators import extract, markdown, script, structured


def item(text, **more):
    return {"id": "x", "text": text, "title": None, "path": None, "url": None, "metadata": None, "parent_id": None, "hash": None, "updated_at": None, "mime_type": None, "source_type": "text", "storage_ref": None} | more


def test_blocks():
    source = "# One #\n\ntext *em* **b** `c*d`\nmore [l](http://a.b/c \"t\") <http://x.y>\n\nSet\n===\n\n- a\n- b [q](u)\n  - c\n\n> quote\n> on\n\n```py\n# code\n```\n\n| a | b |\n|---|---|\n| [x](y) | 2 |\n\n---\n<div>\nhtml\n</div>\n\n    indented\n\n[ref]: http://r.s\n\nsee [ref] and ![img](i.png)\n"
    got = markdown.blocks(source)
    assert [(b.kind, b.line) for b in got] == [("heading", 1), ("paragraph", 3), ("heading", 6), ("list", 9), ("blockquote", 13), ("code", 16), ("table", 20), ("thematicBreak", 24), ("html", 25), ("code", 29), ("definition", 31), ("paragraph", 33)]
    assert got[0].text == "One" and got[2].depth == 1
    assert got[1].text == "text em b c*d\nmore l http://x.y" and got[1].links == [("http://a.b/c", 4), ("http://x.y", 4)]
    assert got[3].text == "ab qc" and got[3].links == [("u", 10)]
    assert got[4].text == "quote\non" and got[5].text == "# code"
    assert got[6].text == "abx2" and got[6].links == [("y", 22)]
    assert got[11].text == "see ref and img" and got[11].links == []  # reference links and images are no links


def test_autolinks():
    text, links = markdown.inline("mail a@b.org, see www.x.org/p. (https://y.org/z)")
    assert text == "mail a@b.org, see www.x.org/p. (https://y.org/z)"
    assert [u for u, _ in links] == ["mailto:a@b.org", "http://www.x.org/p", "https://y.org/z"]


def test_markdown_nodes():
    text = "---\ntitle: My Title\ntags: [Red, blue sky]\n---\n# Top #t1\nbody\n## Sub\nmore #t2\nglued\n#notag\n# Next\n"
    nodes, edges = extract.extract_markdown(item(text, parent_id="p"))
    ids = [n["id"] for n in nodes]
    assert nodes[0]["label"] == "My Title" and "tag:blue-sky" in ids
    assert "doc:x:heading:0:top-t1" in ids and "doc:x:heading:1:sub" in ids and "doc:x:chunk:0" in ids
    up = {e["target"]: e["source"] for e in edges if e["relation"] == "contains"}
    assert up["doc:x:heading:1:sub"] == "doc:x:heading:0:top-t1" and up["doc:x:chunk:1"] == "doc:x:heading:1:sub"
    assert up["doc:x:heading:2:next"] == "doc:x"
    assert {n["label"] for n in nodes if n["type"] == "tag"} >= {"Red", "blue sky", "t1", "t2glued"} and "tag:notag" not in ids
    assert nodes[ids.index("doc:x:heading:0:top-t1")]["source_location"] == "L1"  # lines count from behind the front matter
    assert edges[-1] | {"metadata": None} == edges[-1] and edges[-1]["context"] == "parent_id" and edges[-1]["confidence"] == "INFERRED"


def test_empty_and_null_texts():
    for text in (None, "", "\n\n"):
        nodes, edges = extract.extract_item(item(text))
        assert [n["type"] for n in nodes] == ["document"] and edges == []


def test_json_walk():
    body = {"service": {"url": "https://a.b", "retries": 3}, "features": [{"name": "x", "enabled": True}], "none": None}
    nodes, edges = extract.extract_item(item(json.dumps(body), path="c.json"))
    by_id = {n["id"]: n for n in nodes}
    assert by_id["doc:x:schema:service"]["type"] == "schema_object" and by_id["doc:x:schema:features"]["type"] == "schema_array"
    assert json.loads(by_id["doc:x:schema:service-retries"]["metadata"])["sample"] == 3
    loops = [e for e in edges if e["source"] == e["target"]]
    assert [e["source"] for e in loops] == ["doc:x:schema:features"]  # an array below a key holds itself
    assert [e for e in edges if e["context"] == "schema_value"][0]["target"] == "resource:https-a-b"
    root, _ = extract.extract_item(item("[1, 2]", path="c.json"))
    assert root[1]["id"] == "doc:x:schema:section"
    bad, why = extract.extract_item(item("{", path="c.json"))
    assert bad[1]["type"] == "schema_error" and why[0]["confidence"] == "AMBIGUOUS" and why[0]["confidence_score"] == 0.2


def test_walk_is_bounded():
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}
    ids = [n["id"] for n in structured.walk(item(json.dumps(deep), path="c.json"), {"id": "doc:x"})[0]]
    assert "doc:x:schema:a-b-c-d-e-f" in ids and "doc:x:schema:a-b-c-d-e-f-g" not in ids
    wide, _ = structured.walk(item(json.dumps({f"k{i}": {"v": 1} for i in range(400)}), path="c.json"), {"id": "doc:x"})
    assert 400 <= len(wide) < 700


def test_yaml():
    text = "a: 1\nb:\n  c: 'x'\n  d: true\n  - e: 0x10\nf: [1, 2] # all text\nlist:\n  - one\n# note\ng: 1e3\n"
    assert structured.simple_yaml(text) == {"a": 1, "b": {"c": "x", "d": True, "e": 16}, "f": "[1, 2] # all text", "list": {}, "g": 1000}


SCRIPT = """
import { a, b } from './lib/a';
import React from "react";
export * from '@/shared';
/* function hidden() {} */
const re = /function no\\(/, s = `t ${ nested(1) } function no2()`;
export interface Shape { area(): number }
export type Id = string | number;
enum Color { Red }
export default class Box extends Base implements Shape {
  private size = 3;
  static make(n: number): Box { return new Box(n); }
  constructor(n) { super(); helper(n); }
  area(): number { const inner = this.scale(2); return helper(this.size); }
  scale(k) { return k; }
}
class Base {}
function helper(x) { function deep() { return other(x); } return deep(); }
export const other = async (q: string): Promise<void> => { await helper(q); };
const nested = function (z) { return z; }, plain = 4;
for (let i = 0; i < 3; i++) { helper(i); }
"""


def test_script():
    nodes, edges = extract.extract_item(item(SCRIPT, path="src/m.ts"))
    kinds = {n["label"]: n["type"] for n in nodes}
    assert kinds["Box"] == "class" and kinds["Shape"] == "interface" and kinds["Id"] == "type" and kinds["Color"] == "enum"
    assert kinds["Box.area"] == kinds["Box.scale"] == kinds["Box.make"] == "method" and kinds["Box.size"] == "property"
    assert kinds["helper"] == kinds["other"] == kinds["nested"] == kinds["deep"] == "function" and kinds["plain"] == kinds["re"] == "symbol"
    assert "hidden" not in kinds and "no" not in kinds and "no2" not in kinds and "i" not in kinds
    assert kinds["src/lib/a"] == "resource" and kinds["src/shared"] == "resource" and kinds["react"] == "package"
    found = {(e["source"].split(":")[-1], e["relation"], e["target"].split(":")[-1]) for e in edges}
    assert {("inner", "calls", "box-scale"), ("box-area", "calls", "helper"), ("helper", "calls", "deep"), ("deep", "calls", "other"), ("other", "calls", "helper")} <= found
    assert {("box", "extends", "base"), ("box", "implements", "shape"), ("box", "contains", "box-area"), ("x", "imports_package", "react")} <= found
    assert {n["label"]: n.get("source_location") for n in nodes}["Base"] == "L17"
    owner = {e["target"]: e["source"] for e in edges if e["context"] == "symbol"}
    assert owner["doc:x:symbol:deep"] == "doc:x"  # nested functions belong to the file
    assert owner["doc:x:symbol:inner"] == "doc:x:symbol:box"


def test_script_survives_anything():
    for text in ("", "}{)(", "class {", "const", "`${", "import from", "function (", "a ? b : /x/", "\\", "'"):
        script.Parser(text)


def test_front_matter():
    assert extract.front_matter("no\n---\n") == ({}, "no\n---\n")
    assert extract.front_matter("---\na: 1\n---\nbody") == ({"a": 1}, "body")
    assert extract.front_matter("---\n---\nbody") == ({}, "body")


def test_markdown_of_any_shape_is_read_in_time():
    texts = ["a \U000f0005 b `x`", "a *b " * 20000, "[" * 12000, "[" * 1500 + "]" * 1500, ">" * 1200 + " x", "`a` " * 131000, "[" * 1500 + "x" + "](u)" * 1500, "x" + " " * 100000 + "y", "` `` " * 20000, "<!-- " * 20000, "*_~" * 20000, "[a](" * 20000, "- " * 900 + "x"]
    for text in texts:
        began = time.time()
        assert markdown.blocks(text)
        assert time.time() - began < 10, text[:20]


def test_html_blocks_end_where_they_say():
    got = [(b.kind, b.line) for b in markdown.blocks("<script>\n\n# no\n\n</script>\n# yes\n\n<!-- a\n\n# no\n-->\n\n<div>\n# no\n\n# yes")]
    assert got == [("html", 1), ("heading", 6), ("html", 8), ("html", 13), ("heading", 16)]


def test_emphasis_and_nested_links():
    assert markdown.inline("***both*** **a *b* c** _x_y_ 2 * 3 `*` \\*") == ("both a b c x_y 2 * 3 * *", [])
    assert markdown.inline("[out *[in](x)* side](y) ![i [j](q)](p)") == ("out in side i j", [("y", 1), ("x", 1)])


def test_front_matter_keys_are_strings():
    nodes, _ = extract.extract_markdown({"id": "a", "text": "---\n2024-01-02: x\ntrue: 1\n3: {4: y}\ntitle: T\n---\nbody"})
    assert json.loads(nodes[0]["metadata"])["frontmatter"].keys() == {"2024-01-02", "true", "3", "title"}
