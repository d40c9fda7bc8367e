"""A block scanner for CommonMark with tables, enough to cut a text into its top-level blocks, read
their plain text and find their links. Runs in Python workers; knows nothing of graphs.

Inline text is read in one pass: links are frames on a stack, emphasis is a stack of delimiter runs, and
whatever a delimiter or a bracket has to look for is found once, so time grows as the length of the text.

Known gaps: character entities are those of html.unescape, laziness of continuation lines is limited to
paragraphs in quotes and lists, and quotes and lists nested deeper than `DEPTH` are read as a paragraph."""

from __future__ import annotations

import bisect
import html
import re
from typing import NamedTuple

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:( +)(.*)|[ \t]*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}<(?:!--|[?]|![A-Za-z]|!\[CDATA\[|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\]\\]|\\.)+)\]:\s*(<[^>\n]*>|\S+)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]]+\]:")
_ROW = re.compile(r" {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


#: What a line that starts a block, and is not blank, begins with
_FIRST = frozenset(["", *"#`~-*_>+<0123456789"])
#: HTML blocks that go on over blank lines, and what ends each
_HTML_SPANS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<[?]"), re.compile(r"[?]>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
)
DEPTH = 100


class Block(NamedTuple):
    kind: str
    line: int
    text: str
    links: list[tuple[str, int]]
    depth: int = 0


def blocks(source: str) -> list[Block]:
    """Top-level blocks in order, lines counted from 1."""
    lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    known = {_label(m[1]) for x in lines if (m := _DEFINITION.match(x)) and not m[1].startswith("^")}
    return _scan(lines, 1, known)


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


def _starts_block(line: str) -> bool:
    if line.lstrip(" ")[:1] not in _FIRST:
        return False
    item = _ITEM.match(line)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or (item and item[4] and item[2] in "-*+1.1)") or re.match(r" {0,3}<(?:!--|/?(?:div|p|table|ul|ol|pre|script|style|section|h[1-6])\b)", line, re.I))


def _indented(line: str) -> bool:
    return line.startswith("    ") or line.startswith("\t")


def _scan(lines: list[str], first: int, known: set[str], depth: int = 0) -> list[Block]:
    out: list[Block] = []
    i = 0
    if depth > DEPTH:
        text, links = inline("\n".join(x.strip() for x in lines), first, known)
        return [Block("paragraph", first, text, links)]

    def inner(kind: str, at: int, content: list[str]) -> Block:
        parts = _scan(content, at, known, depth + 1)
        return Block(kind, at, "".join(p.text for p in parts), [x for p in parts for x in p.links])

    while i < len(lines):
        line, at = lines[i], first + i
        if not line.strip():
            i += 1
        elif _indented(line):
            j = i
            while j < len(lines) and (_indented(lines[j]) or not lines[j].strip()):
                j += 1
            body = "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:j]).rstrip("\n ")
            out.append(Block("code", at, body, []))
            i = j
        elif m := _ATX.match(line):
            text, links = inline(m[2] or "", at, known)
            out.append(Block("heading", at, text, links, len(m[1])))
            i += 1
        elif (m := _FENCE.match(line)) and not (m[1][0] == "`" and "`" in m[2]):
            j = i + 1
            close = re.compile(r" {0,3}" + re.escape(m[1][0]) + "{" + str(len(m[1])) + r",}[ \t]*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            out.append(Block("code", at, "\n".join(lines[i + 1 : j]), []))
            i = j + 1
        elif _RULE.match(line):
            out.append(Block("thematicBreak", at, "", []))
            i += 1
        elif _QUOTE.match(line):
            j, content = i, []
            while j < len(lines) and (_QUOTE.match(lines[j]) or lines[j].strip() and content and content[-1].strip() and not _starts_block(lines[j])):
                content.append(_QUOTE.sub("", lines[j], count=1))
                j += 1
            out.append(inner("blockquote", at, content))
            i = j
        elif m := _ITEM.match(line):
            block, i = _list(lines, i, first, known, inner)
            out.append(block)
        elif _FOOTNOTE.match(line):
            j = i + 1
            while j < len(lines) and lines[j].strip() and not _starts_block(lines[j]):
                j += 1
            out.append(inner("footnoteDefinition", at, [_FOOTNOTE.sub("", line).strip(), *lines[i + 1 : j]]))
            i = j
        elif _DEFINITION.match(line):
            out.append(Block("definition", at, "", []))
            i += 1
        elif _HTML.match(line):
            j = i
            end = next((e for start, e in _HTML_SPANS if start.match(line)), None)
            if end:
                while j < len(lines) and not end.search(lines[j]):
                    j += 1
                j = min(j + 1, len(lines))
            while not end and j < len(lines) and lines[j].strip():
                j += 1
            out.append(Block("html", at, "\n".join(lines[i:j]), []))
            i = j
        elif "|" in line and i + 1 < len(lines) and _ROW.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            j = i + 2
            while j < len(lines) and lines[j].strip() and not _starts_block(lines[j]):
                j += 1
            text, links = "", []
            for k in [i, *range(i + 2, j)]:
                for cell in _cells(lines[k]):
                    t, found = inline(cell, first + k, known)
                    text += t
                    links += found
            out.append(Block("table", at, text, links))
            i = j
        else:
            j, level = i + 1, 0
            while j < len(lines) and lines[j].strip():
                if m := _SETEXT.match(lines[j]):
                    level = 1 if m[1][0] == "=" else 2
                    break
                if _starts_block(lines[j]):
                    break
                j += 1
            text, links = inline("\n".join(x.strip() for x in lines[i:j]), at, known)
            out.append(Block("heading" if level else "paragraph", at, text, links, level))
            i = j + 1 if level else j
    return out


def _list(lines: list[str], i: int, first: int, known: set[str], inner) -> tuple[Block, int]:
    kind, at = _ITEM.match(lines[i])[2][-1], first + i
    parts: list[Block] = []
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m or m[2][-1] != kind or _RULE.match(lines[i]):
            break
        width = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] and len(m[3]) <= 4 else 1)
        content, j, blank = [lines[i][width:] if len(lines[i]) > width else ""], i + 1, False
        while j < len(lines):
            x = lines[j]
            if not x.strip():
                blank = True
                content.append("")
            elif len(x) - len(x.lstrip(" ")) >= width:
                content.append(x[width:])
                blank = False
            elif not blank and not _ITEM.match(x) and not _starts_block(x):
                content.append(x.lstrip())
            else:
                break
            j += 1
        if content and re.match(r"\[[ xX]\] ", content[0]):
            content[0] = content[0][4:]
        parts.append(inner("listItem", first + i, content))
        i = j
    return Block("list", at, "".join(p.text for p in parts), [x for p in parts for x in p.links]), i


_TOKEN = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])"
    r"|(?P<tick>`+)"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+)>"
    r"|(?P<tag></?[A-Za-z][^<>]*>)"
    r"|(?P<comment><!--)"
    r"|(?P<bang>!?)(?P<open>\[)"
    r"|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"
    r"|(?<![\w/])(?P<url>(?:https?://|www\.)[^\s<]+)"
    r"|(?<![\w.+-])(?P<mail>[A-Za-z0-9._+-]++@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z0-9_-]*[A-Za-z0-9])"
    r"|(?P<mark>\*+|_+|~+)",
    re.S,
)
#: The same for texts without '@', in which no address can begin, and what a text has that is not plain
_TOKEN_NO_MAIL = re.compile(re.sub(r"\(\?P<mail>.*\n?(?=\|\(\?P<mark>)", "(?P<mail>(?!))", _TOKEN.pattern), re.S)
_SPECIAL = re.compile(r"[\\`<\[&*_~@]|https?://|www\.")
_TARGET = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^)\\]|\\.)*\)))?\s*\)", re.S)
_BREAK = re.compile(r"(?:(?<! ) {2,}|\\)\n")
_REFERENCE = re.compile(r"\[([^\]]*)\]")
#: Labels of link definitions have at most 999 signs
_LABEL = 999


def _brackets(s: str) -> dict[int, int]:
    """The closing bracket of each opening one that has any."""
    found, open_, i = {}, [], 0
    for m in re.finditer(r"\\.|[\[\]]", s, re.S):
        i = m.start()
        if s[i] == "[":
            open_.append(i)
        elif s[i] == "]" and open_:
            found[open_.pop()] = i
    return found


def _emphasis(pieces: list, lo: int) -> None:
    """Takes the delimiters that pair off the runs among pieces[lo:], each a list [sign, count, opens, closes]; the rest are text."""
    openers: list[int] = []
    floor: dict[tuple, int] = {}  # below this, nothing opens for such a closer
    for k in range(lo, len(pieces)):
        run = pieces[k]
        if not isinstance(run, list):
            continue
        sign, size, opens, closes = run[0], run[4], run[2], run[3]
        while closes and run[1]:
            kind = sign, opens, size % 3
            j = len(openers) - 1
            while j >= floor.get(kind, 0):
                other = pieces[openers[j]]
                odd = (other[3] or opens) and (other[4] + size) % 3 == 0 and (other[4] % 3 or size % 3)
                if other[0] == sign and other[1] and not (odd and sign != "~") and (sign != "~" or other[1] == run[1]):
                    break
                j -= 1
            else:
                floor[kind] = len(openers)
                break
            n = run[1] if sign == "~" else 2 if run[1] > 1 and other[1] > 1 else 1
            run[1] -= n
            other[1] -= n
            del openers[j + 1 :]
            if not other[1]:
                openers.pop()
            floor = {k: min(v, len(openers)) for k, v in floor.items()}
        if opens and run[1]:
            openers.append(k)
    for k in range(lo, len(pieces)):
        if isinstance(pieces[k], list):
            pieces[k] = pieces[k][0] * pieces[k][1]


def _run(s: str, lo: int, hi: int) -> list:
    """A run of delimiters, [sign, count, opens, closes, length], by what stands beside it."""
    before, after = s[lo - 1] if lo else " ", s[hi] if hi < len(s) else " "
    punct = lambda c: not (c.isalnum() or c.isspace())
    left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
    right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
    if s[lo] == "_":
        return ["_", hi - lo, left and (not right or punct(before)), right and (not left or punct(after)), hi - lo]
    return [s[lo], hi - lo, left and (s[lo] != "~" or hi - lo < 3), right and (s[lo] != "~" or hi - lo < 3), hi - lo]


def inline(s: str, line: int = 1, known: set[str] | None = None) -> tuple[str, list[tuple[str, int]]]:
    """(plain text, links as (url, line)) of inline Markdown."""
    if not _SPECIAL.search(s):
        return _BREAK.sub("", s), []
    token = _TOKEN if "@" in s else _TOKEN_NO_MAIL
    known = known or set()
    links: list[tuple[str, int]] = []
    pieces: list = []  # text, or runs of delimiters
    close = _brackets(s)
    frames: list[tuple[int, int, int, bool]] = []  # open labels: (end, where to go on, first piece, whether it is an image)
    images = 0
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", s):
        ticks.setdefault(m.end() - m.start(), []).append(m.start())
    no_comment_after = len(s)
    here, counted = line, 0

    def plain(lo: int, hi: int) -> None:
        if hi > lo:
            pieces.append(_BREAK.sub("", s[lo:hi]))

    i = 0
    while True:
        m = token.search(s, i, frames[-1][0] if frames else len(s))
        at = m.start() if m else len(s)
        if frames and at >= frames[-1][0]:
            end, then, first, image = frames.pop()
            plain(i, end)
            _emphasis(pieces, first)
            images -= image
            i = then
            continue
        if not m:
            plain(i, len(s))
            break
        plain(i, at)
        here += s.count("\n", counted, at)
        counted, i = at, m.end()
        if m["escape"]:
            pieces.append(m["escape"][1])
        elif m["mark"]:
            pieces.append(_run(s, at, i))
        elif m["tick"]:
            same = ticks.get(i - at, [])
            k = bisect.bisect_left(same, i)
            limit = frames[-1][0] if frames else len(s)
            if k < len(same) and same[k] < limit:
                body = s[i : same[k]].replace("\n", " ")
                pieces.append(body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body)
                i = same[k] + len(m["tick"])
            else:
                pieces.append(m["tick"])
        elif m["auto"]:
            if not images:
                links.append((m["auto"] if ":" in m["auto"] else "mailto:" + m["auto"], here))
            pieces.append(m["auto"])
        elif m["tag"]:
            pieces.append(m["tag"])
        elif m["comment"]:
            end = s.find("-->", i) if i < no_comment_after else -1
            if end < 0:
                no_comment_after = min(no_comment_after, i)
                pieces.append("<!--")
            else:
                pieces.append(s[at : end + 3])
                i = end + 3
        elif m["entity"]:
            pieces.append(html.unescape(m["entity"]))
        elif m["url"] or m["mail"]:
            raw = m["url"] or m["mail"]
            if m["url"]:
                raw = re.sub(r"[?!.,:*_~'\"]++$", "", raw)
                extra = raw.count(")") - raw.count("(")
                while extra > 0 and raw.endswith(")"):
                    raw, extra = raw[:-1], extra - 1
            if frames:
                raw = raw[: max(1, frames[-1][0] - at)]
            else:
                links.append((raw if raw.startswith("http") else ("mailto:" if m["mail"] else "http://") + raw, here))
            pieces.append(raw)
            i = at + len(raw)
        else:
            end = close.get(i - 1, -1)
            limit = frames[-1][0] if frames else len(s)
            if end < 0 or end >= limit:
                pieces.append(m.group())
                continue
            image = bool(m["bang"])
            if s[end + 1 : end + 2] == "(" and (target := _TARGET.match(s, end + 1)):
                url = target[1][1:-1] if target[1].startswith("<") else target[1]
                if not image and not images:
                    links.append((html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", url)), here))
                then = target.end()
            elif end - i <= _LABEL and (ref := _REFERENCE.match(s, end + 1)) and _label(ref[1] or s[i:end]) in known:
                then = ref.end()
            elif end - i <= _LABEL and known and _label(s[i:end]) in known:
                then = end + 1
            elif s[i : i + 1] == "^" and end > i + 1 and "]" not in s[i:end]:
                i = end + 1  # a footnote reference has no text
                continue
            else:
                pieces.append(m.group())
                continue
            frames.append((end, then, len(pieces), image))
            images += image
    _emphasis(pieces, 0)
    return "".join(pieces), links
