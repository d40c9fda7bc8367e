"""Symbols, imports, calls and heritage of JavaScript and TypeScript by a tokenizer and a walk over
brackets. Runs in Python workers.

Known gaps against a compiler: JSX text is read as code, a `<` that opens type arguments is told from
a comparison only in declarations, and decorators count as calls of their owner."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from ..functions import text as X

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|$))"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)"
    r"|(?P<template>`)"
    r"|(?P<name>[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)"
    r"|(?P<number>\d[\w.]*)"
    r"|(?P<regex>/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
    r"|(?P<sign>=>|\?\.|\.\.\.|[{}()\[\];,.<>=:?!&|+*/%^~-])"
    r"|(?P<other>.)",
    re.S,
)
_NO_VALUE = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "abstract", "override", "declare", "get", "set", "accessor"}
_STARTS = set("const let var function class interface type enum export import return if for while namespace module declare abstract async".split())
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "import", "super", "with", "new", "constructor", "yield", "void", "delete"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Token]:
    """Code without space and comments; templates are cut into their embedded expressions."""
    out: list[Token] = []
    i, line = 0, 1
    stack: list[int] = []  # open braces inside each template expression
    while i < len(source):
        if stack and source[i] == "}" and stack[-1] == 0:
            stack.pop()
            i, line = _template(source, i + 1, line, stack, out)
            continue
        m = _TOKEN.match(source, i)
        kind, text = m.lastgroup, m.group()
        if kind == "regex":
            last = out[-1] if out else None
            if last and (last.kind in ("number", "string") or last.kind == "name" and last.text not in _NO_VALUE or last.text in (")", "]", "}")):
                kind, text = "sign", "/"
        i += len(text)
        if kind == "template":
            i, line = _template(source, i, line, stack, out)
            continue
        if stack and text in "{}" and kind == "sign":
            stack[-1] += 1 if text == "{" else -1
        if kind not in ("space", "regex"):
            out.append(Token(kind, text, line))
        elif kind == "regex":
            out.append(Token("string", text, line))
        line += text.count("\n")
    return out


def _template(source: str, i: int, line: int, stack: list[int], out: list[Token]) -> tuple[int, int]:
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            out.append(Token("string", "``", line))
            return i + 1, line
        elif source.startswith("${", i):
            stack.append(0)
            return i + 2, line
        else:
            line += source[i] == "\n"
            i += 1
    return i, line


class Declaration(NamedTuple):
    label: str
    kind: str
    line: int
    start: int
    end: int
    owner: str  # label of the class around it, '' for the file


class Parser:
    def __init__(self, source: str):
        self.t = tokens(source)
        self.match = self._brackets()
        self.declared: list[Declaration] = []
        self.heritage: list[tuple[str, str, str, int]] = []
        self.imports: list[tuple[str, int]] = []
        self._statements(0, len(self.t), "")

    def _brackets(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "sign" and t.text in "([{":
                stack.append(i)
            elif t.kind == "sign" and t.text in ")]}" and stack:
                out[stack.pop()] = i
        return out

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def _name(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == "name"

    def _end(self, i: int, stop: int) -> int:
        """Where the statement or declarator that goes on at i ends."""
        started = self.t[i].line if i < len(self.t) else 0
        while i < stop:
            x = self.t[i]
            if x.kind == "sign" and x.text in (";", ",", "}", ")", "]"):
                return i
            if x.line > started and x.kind == "name" and x.text in _STARTS and self.text(i - 1) not in (".", "=", "=>", ":", "(", "?"):
                return i
            started = x.line
            if i in self.match:
                i = self.match[i]
                started = self.t[i].line
            i += 1
        return stop

    def _body(self, i: int, stop: int) -> int:
        """The brace that opens a body after i, stop if a statement ends before one."""
        while i < stop:
            x = self.text(i)
            if x == "{" and self.text(i - 1) not in (":", "|", "&", "<", ",", "=", "=>"):
                return i
            if x == ";":
                return stop
            i = self.match[i] + 1 if i in self.match else i + 1
        return stop

    def _statements(self, i: int, stop: int, owner: str) -> None:
        while i < stop:
            t, before = self.t[i], self.text(i - 1)
            if t.kind != "name" or before in (".", "?."):
                i += 1
            elif t.text == "function" and (self._name(i + 1) or self.text(i + 1) == "*" and self._name(i + 2)):
                at = i + 1 if self._name(i + 1) else i + 2
                body = self._body(at, stop)
                end = self.match.get(body, at)
                # a function that is a value is an expression: its name is no symbol
                if before not in ("=", "(", ",", ":", "=>", "return", "[", "?", "!"):
                    self.declared.append(Declaration(self.text(at), "function", self.t[self._first(i)].line, i, end, owner))
                i = at + 1
            elif t.text == "class" and self._name(i + 1) and before not in ("=", "(", ",", "return", "=>"):
                i = self._class(i, stop, owner)
            elif t.text == "interface" and self._name(i + 1) and self.text(i + 2) in ("{", "extends", "<"):
                body = self._body(i + 2, stop)
                self.declared.append(Declaration(self.text(i + 1), "interface", self.t[self._first(i)].line, i, self.match.get(body, i + 1), owner))
                self._clauses(self.text(i + 1), i + 2, body)
                i = self.match.get(body, i + 1) + 1
            elif t.text == "type" and self._name(i + 1) and self.text(i + 2) in ("=", "<"):
                end = self._end(i + 2, stop)
                self.declared.append(Declaration(self.text(i + 1), "type", self.t[self._first(i)].line, i, end, owner))
                i = end
            elif t.text == "enum" and self._name(i + 1) and self.text(i + 2) == "{":
                self.declared.append(Declaration(self.text(i + 1), "enum", self.t[self._first(i)].line, i, self.match.get(i + 2, i), owner))
                i = self.match.get(i + 2, i + 2) + 1
            elif t.text in ("const", "let", "var") and self._name(i + 1) and self.text(i + 1) != "enum" and not (before == "(" and self.text(i - 2) in ("for", "await")):
                self._variables(i + 1, stop, owner)
                i += 1
            elif t.text in ("import", "export") and before != "." and self.text(i + 1) not in ("(", "."):
                self._import(i, stop)
                i += 1
            else:
                i += 1

    def _first(self, i: int) -> int:
        while i and self.text(i - 1) in ("export", "default", "async", "abstract", "declare", "const"):
            i -= 1
        return i

    def _variables(self, i: int, stop: int, owner: str) -> None:
        while self._name(i):
            name, line, start = self.text(i), self.t[i].line, i
            end = self._end(i, stop)
            equal = next((k for k in self._level(i, end) if self.text(k) == "="), None)
            value = self.text(equal + 1) if equal is not None else ""
            k = equal + 1 if equal is not None else end
            if value == "async":
                k, value = k + 1, self.text(k + 1)
            arrow = value == "function"
            if value == "(" and k in self.match:
                after = self.match[k] + 1
                arrow = self.text(after) == "=>" or self.text(after) == ":" and any(self.text(x) == "=>" for x in self._level(after, end))
            elif value == "<":
                arrow = any(self.text(x) == "=>" for x in self._level(k, end))
            elif k < end and self._name(k) and self.text(k + 1) == "=>":
                arrow = True
            self.declared.append(Declaration(name, "function" if arrow else "symbol", line, start, end, owner))
            if self.text(end) != ",":
                return
            i = end + 1

    def _level(self, i: int, stop: int):
        while i < stop:
            yield i
            i = self.match[i] + 1 if i in self.match else i + 1

    def _class(self, i: int, stop: int, owner: str) -> int:
        name, body = self.text(i + 1), self._body(i + 2, stop)
        end = self.match.get(body, i + 1)
        self.declared.append(Declaration(name, "class", self.t[self._first(i)].line, i, end, owner))
        self._clauses(name, i + 2, body)
        k = body + 1
        while k < end:
            start = k
            while self._name(k) and self.text(k) in _MODIFIERS and self.text(k + 1) not in ("(", "=", ":", ";", "?", "!"):
                k += 1
            if self.text(k) == "*":
                k += 1
            if not self._name(k) or self.text(k).startswith(("#", "@")):
                k = self.match[k] + 1 if k in self.match else k + 1
                continue
            member, after = self.text(k), self.text(k + 1)
            accessor = any(self.text(x) in ("get", "set") for x in range(start, k))
            paren = next((x for x in range(k + 1, min(end, k + 12)) if self.text(x) == "("), end) if after in ("(", "<", "?") else end
            if paren < end and (after in ("(", "<") or self.text(k + 2) == "("):
                inner = self._body(self.match.get(paren, paren) + 1, end)
                close = self.match.get(inner, self._end(paren, end)) if inner < end else self._end(self.match.get(paren, paren) + 1, end)
                if member != "constructor" and not accessor:
                    self.declared.append(Declaration(f"{name}.{member}", "method", self.t[start].line, start, close, name))
                self._statements(paren, close, name)
                k = close + 1
            else:
                close = self._property_end(k + 1, end)
                self.declared.append(Declaration(f"{name}.{member}", "property", self.t[start].line, start, close, name))
                self._statements(k + 1, close, name)
                k = close if close > k else k + 1
        return end + 1

    def _property_end(self, i: int, end: int) -> int:
        line = self.t[i - 1].line
        while i < end:
            x = self.t[i]
            if x.text == ";" or x.line > line and x.kind == "name" and self.text(i - 1) not in ("=", ":", "|", "&", "=>", ".", ",", "(", "+"):
                return i
            if i in self.match:
                i = self.match[i]
            line = self.t[i].line
            i += 1
        return end

    def _clauses(self, name: str, i: int, stop: int) -> None:
        relation = ""
        while i < stop:
            x = self.text(i)
            if x in ("extends", "implements"):
                relation = x
            elif relation and self._name(i):
                k = i
                while self.text(k + 1) == "." and self._name(k + 2):
                    k += 2
                self.heritage.append((name, relation, self.text(k), self.t[i].line))
                i = k
                if self.text(i + 1) == "<":
                    i = self._angle(i + 1, stop)
            i = self.match[i] + 1 if i in self.match else i + 1

    def _angle(self, i: int, stop: int) -> int:
        depth = 0
        while i < stop:
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            if not depth:
                return i
            i += 1
        return stop

    def _import(self, i: int, stop: int) -> None:
        line, k = self.t[i].line, i + 1
        if k < stop and self.t[k].kind == "string":
            self.imports.append((self.t[k].text[1:-1], line))
            return
        if self.text(i) == "export" and self.text(k) not in ("{", "*", "type"):
            return
        while k < stop and self.text(k) != ";":
            if self.text(k) == "from" and k + 1 < stop and self.t[k + 1].kind == "string":
                self.imports.append((self.t[k + 1].text[1:-1], line))
                return
            if self.text(k) in ("=", "const", "function", "class", "import", "export") or self.text(k) == "(":
                return
            k = self.match[k] + 1 if k in self.match else k + 1

    def calls(self) -> list[tuple[str, str, int]]:
        """(label of the innermost declaration around, name called, line)"""
        out = []
        for i, t in enumerate(self.t):
            if t.kind != "name" or self.text(i + 1) != "(" or t.text in _NOT_CALLED or self.text(i - 1) in ("function", "new", "*"):
                continue
            around = [d for d in self.declared if d.start <= i <= d.end]
            if not around:
                continue
            inner = max(around, key=lambda d: (d.start, -d.end))
            if inner.kind == "method" and i <= inner.start + 4 and inner.label.rsplit(".", 1)[-1] == t.text and all(self.text(x) in _MODIFIERS for x in range(inner.start, i)):
                continue  # the method's own name
            k = i
            while self.text(k - 1) == "." and k >= 2:
                k -= 2
            line = self.t[k].line
            if self.text(k - 1) == "new":
                continue
            out.append((inner.label, t.text, line))
        return out


def extract(item: dict, document: dict) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of a script below its document node."""
    doc, nodes, edges = document["id"], [document], []
    path = (item.get("path") or "").replace("\\", "/")
    parsed = Parser(item["text"])
    ids: dict[str, list[str]] = {}
    seen: set[str] = set()

    def edge(source: str, target: str, relation: str, context: str, line: int, score: float | None = 1.0, about: dict | None = None) -> None:
        edges.append({"source": source, "target": target, "relation": relation, "confidence": "EXTRACTED", "confidence_score": score, "source_item_id": item["id"], "source_location": f"L{line}", "context": context, "metadata": json.dumps(about, ensure_ascii=False) if about else None})

    def symbol(label: str) -> str:
        return f"{doc}:symbol:{X.py_slugify(label)}"

    for d in parsed.declared:
        label = X.py_sanitize_label(d.label)
        if not label:
            continue
        node = symbol(label)
        if node not in seen:
            seen.add(node)
            nodes.append({"id": node, "label": label, "type": d.kind, "source_item_id": item["id"], "source_location": f"L{d.line}", "path": path, "metadata": json.dumps({"path": path}, ensure_ascii=False)})
            edge(symbol(d.owner) if d.owner else doc, node, "contains", "symbol", d.line, None)
        for name in {label.rsplit(".", 1)[-1], label}:
            ids.setdefault(name, []).append(node)
    known: set[str] = set()
    found = []
    for spec, line in parsed.imports:
        near = spec.startswith((".", "@/"))
        name = X.py_resolve_relative_path(item.get("path"), spec) if near else spec
        node = f"{'resource' if near else 'package'}:{X.py_slugify(name)}"
        if node not in known:
            known.add(node)
            about = {"href": name} if near else {"package": name}
            nodes.append({"id": node, "label": name, "type": "resource" if near else "package", "source_item_id": item["id"], "href": name if near else None, "metadata": json.dumps(about, ensure_ascii=False)})
        found.append((line, doc, node, "imports" if near else "imports_package", "import", {"specifier": spec}))
    for around, name, line in parsed.calls():
        target = ids.get(name, [None])[0]
        if target and target != symbol(around):
            found.append((line, symbol(around), target, "calls", "call", None))
    for name, relation, base, line in parsed.heritage:
        source, target = ids.get(name, [None])[0], ids.get(base, [None])[0]
        if source and target and source != target:
            found.append((line, source, target, relation, "heritage", None))
    for line, source, target, relation, context, about in sorted(found, key=lambda x: x[0]):
        edge(source, target, relation, context, line, 1.0, about)
    return nodes, edges
