"""Secret scans through nested encodings.

Each text is the first entry of a worklist. A layer is scanned for secrets; then each part of it
that reads as an encoding - tokens with URL escapes, tokens with Unicode escapes, base64 runs, within a
line or wrapped over lines, and what any of them holds compressed (gzip, zlib, zstandard, bzip2, xz) - is
decoded and joins the worklist. A digest of the layers on the way from the text stops cycles, so the list
empties: the fixpoint. Of compressed content all members or frames are read. Bytes that are not UTF-8 are
read as Latin-1, and bytes with zeros as UTF-16 also.
Every layer knows how to trace its characters back to the text, so that a finding has the span of the
original it came from; what was compressed has the span of the whole token. A trace is arithmetic or
has a number an escape, so a layer of many megabytes needs little more than its characters.

One narrow pass, no shuffle. Whole texts are scanned, however long. A layer that would inflate
beyond `max_layer` bytes is reported as `oversized_layer` rather than dropped.

Edge cases: null and empty texts have no findings; equal findings of one layer at one place are one;
the same secret at several places or through several encodings is reported for each, also where
a line or part of a base64 run reads as well as the whole; repeated
rows report each; the secret itself is never returned, but its SHA-256.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points

SCHEMA = "doc_id bigint, kind string, span_start int, span_end int, depth int, encodings string, secret_sha256 string"
MAX_LAYER = 64 << 20
#: Bytes of zstandard input at a time: they inflate to a few MB at most
ZSTD_STEP = 256

_RULES = (
    ("aws_access_key", r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])"),
    ("github_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{40,255})"),
    ("slack_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("stripe_key", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}"),
    ("json_web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    ("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
    ("url_password", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]+:[^\s/@]+@[^\s/]+"),
    ("assigned_secret", r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]asswo?r?d|PASSWORD|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9+/_.=-]{12,})"),
)
_SECRET = re.compile("|".join(f"(?P<{n}>{r})" for n, r in _RULES))
# What every rule contains: texts without any of it need no search
_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk_", "rk_", "AIza", "eyJ", "-----BEGIN", "://")
_HINTS_LOWER = ("token", "secret", "passw", "api_key", "api-key", "apikey")
# Runs are tried where they begin only, so a long one costs its length
_PERCENT = re.compile(r"(?<![^\s%])[^\s%]*+(?:%[0-9A-Fa-f]{2}[^\s%]*+)+")
_UNICODE = re.compile(r"(?<![^\s\\])[^\s\\]*+(?:\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}|U[0-9A-Fa-f]{8})[^\s\\]*+)+")
_HEX = re.compile(rb"%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\(?:u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
#: Runs of both alphabets, and of either: a token can be glued to others by a sign of the other alphabet
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Runs of lines, of which the first may begin and the last end within a line
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")


#: From a span of a layer to the span it came from
Trace = Callable[[int, int], tuple[int, int]]


class Layer(NamedTuple):
    text: str
    origin: Trace
    path: tuple[str, ...]
    seen: frozenset


class Oversized(Exception):
    pass


def _whole(size: int) -> Trace:
    return lambda a, b: (0, size)


def _after(first: Trace, then: Trace) -> Trace:
    return lambda a, b: then(*first(a, b))


def _stretched(at: np.ndarray, extra: np.ndarray) -> Trace:
    """Trace of signs that were one longer by extra[i] at at[i]; all others are as they were."""
    more = np.append(0, np.cumsum(extra))
    return lambda a, b: (a + int(more[np.searchsorted(at, a)]), b + int(more[np.searchsorted(at, b)]))


def _percent(s: str) -> tuple[bytes, Trace]:
    """The bytes of s without its escapes, and the trace of bytes to characters."""
    raw = s.encode("utf-8", "surrogatepass")
    at = np.fromiter((m.start() for m in _HEX.finditer(raw)), dtype=np.int64)
    data = _HEX.sub(lambda m: bytes((int(m[1], 16),)), raw)
    # of the n-th escape, the place among the bytes that stay
    long = _stretched(at - 2 * np.arange(len(at)), np.full(len(at), 2))
    return (data, long) if len(raw) == len(s) else (data, _after(long, _by_char(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80)))


def _by_char(starts: np.ndarray) -> Trace:
    """Trace of bytes to characters, `starts` marking the bytes that begin one."""
    char = np.cumsum(starts, dtype=np.int32) - 1
    return lambda a, b: (int(char[a]), int(char[b - 1]) + 1)


def _chars(data: bytes) -> tuple[str, Trace | None]:
    """The text of UTF-8 bytes, or of Latin-1 where they are none, and the trace of characters to bytes, None if it is plain."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), None
    if len(text) == len(data):
        return text, None
    cp = code_points(text)
    wide = np.flatnonzero(cp >= 0x80)
    return text, _stretched(wide, (1 + (cp[wide] >= 0x800) + (cp[wide] >= 0x10000)).astype(np.int64))


def _escapes(s: str) -> tuple[str, Trace]:
    out, place, extra, at, size = [], [], [], 0, 0
    for m in _ESCAPE.finditer(s):
        if m[1]:
            code = 0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF)
        else:
            code = int(next(g for g in m.groups() if g), 16)
        size += m.start() - at
        out += (s[at : m.start()], chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
        place.append(size)
        extra.append(m.end() - m.start() - 1)
        size += 1
        at = m.end()
    out.append(s[at:])
    return "".join(out), _stretched(np.array(place, dtype=np.int64), np.array(extra, dtype=np.int64))


def _member(data: bytes, limit: int) -> tuple[bytes, bytes, str] | None:
    """Content of the first member or frame of compressed data, what follows it, and its name; None if
    the data are not compressed."""
    try:
        if data[:2] == b"\x1f\x8b":
            d, name = zlib.decompressobj(31), "gzip"
        elif data[:3] == b"BZh":
            d, name = bz2.BZ2Decompressor(), "bzip2"
        elif data[:6] == b"\xfd7zXZ\x00":
            d, name = lzma.LZMADecompressor(), "xz"
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            out, d = bytearray(), zstandard.ZstdDecompressor().decompressobj()
            for at in range(0, len(data), ZSTD_STEP):  # it has no limit of its own
                out += d.decompress(data[at : at + ZSTD_STEP])
                if len(out) > limit:
                    raise Oversized
                if d.eof:
                    return bytes(out), d.unused_data + data[at + ZSTD_STEP :], "zstd"
            return bytes(out), b"", "zstd"
        elif data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
            d, name = zlib.decompressobj(), "zlib"
        else:
            return None
        out = d.decompress(data, limit + 1)
        if len(out) > limit:
            raise Oversized
        return out, d.unused_data, name
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        return None


def _inflate(data: bytes, limit: int) -> tuple[bytes, str] | None:
    """Content of all members and what follows them as it is, and the name of the first; None if the
    data are not compressed."""
    out, first = bytearray(), None
    while got := _member(data, limit - len(out)):
        out += got[0]
        data = got[1].lstrip(b"\0")  # members may be padded
        first = first or got[2]
    if first is None:
        return None
    out += data
    if len(out) > limit:
        raise Oversized
    return bytes(out), first


def _hinted(text: str) -> bool:
    if any(x in text for x in _HINTS):
        return True
    low = text.lower()
    return any(x in low for x in _HINTS_LOWER)


def _worth(text: str) -> bool:
    """Whether a scan of text can find anything."""
    return _hinted(text) or any(x.search(text) for x in (_BASE64, _WRAPPED)) or "%" in text and bool(_PERCENT.search(text)) or "\\" in text and bool(_UNICODE.search(text))


def _utf16(data: bytes) -> Iterator[tuple[str, int]]:
    """Texts that the data may hold in units of two bytes, in either order, and where they begin."""
    for at in (0, 1):
        n = (len(data) - at) // 2
        texts = (np.frombuffer(data, f"{order}u2", n, at).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for order in "<>")
        if worth := [(t, at) for t in texts if _worth(t)]:
            yield from worth
            return


def _pieces(text: str) -> Iterator[tuple[tuple[int, int], ...]]:
    """Spans that may be base64, as the pieces of one run each."""
    for m in _BASE64.finditer(text):
        yield from dict.fromkeys(((m.span(),), *((n.span(),) for alphabet in _ALPHABETS for n in alphabet.finditer(text, *m.span()))))
    if "\n" in text or "\r" in text:
        for m in _WRAPPED.finditer(text):
            lines = [n.span() for n in _PIECE.finditer(text, *m.span())]
            size = [b - a for a, b in lines]
            runs = {(0, len(lines)): None, (0, len(lines) - 1): None}
            # lines of one width and the shorter one after them, whatever else stands in the lines around
            i = 0
            while i < len(lines):
                j = i + 1
                while j < len(lines) and size[j] == size[i]:
                    j += 1
                runs[i, j] = None
                if j < len(lines) and size[j] < size[i]:
                    runs[i, j + 1] = None
                i = j
            for i, j in runs:
                if j - i > 1 and sum(size[i:j]) >= 16:
                    yield tuple(lines[i:j])


Part = tuple[str, Trace, tuple[str, ...]]


def _read(data: bytes, trace: Trace, size: int, name: str, limit: int) -> Iterator[Part]:
    """What decoded bytes hold that is worth a scan: their content if they are compressed, else their text."""
    names, content = [name], data
    while inner := _inflate(content, limit):
        content, packed = inner
        names.append(packed)
    trace = trace if len(names) == 1 else _whole(size)
    text, by_byte = _chars(content)
    if _worth(text):
        yield text, trace if by_byte is None or len(names) > 1 else _after(by_byte, trace), tuple(names)
    if b"\0" in content:
        for text, at in _utf16(content):
            yield text, trace if len(names) > 1 else _after(lambda a, b, at=at: (at + 2 * a, at + 2 * b), trace), (*names, "utf16")


def _base64(s: str, limit: int) -> Iterator[Part]:
    body = s.rstrip("=")
    body = body[:-1] if len(body) % 4 == 1 else body
    try:
        data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return iter(())
    return _read(data, lambda a, b: (a * 4 // 3, min(-(-b * 4 // 3), len(s))), len(s), "base64", limit)


def _unicode(s: str, limit: int) -> Iterator[Part]:
    text, trace = _escapes(s)
    if _worth(text):
        yield text, trace, ("unicode",)
    if text.isascii() and "\0" not in text:
        return
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return
    # signs that are bytes, and maybe compressed or of another code; as text they were read already
    yield from (x for x in _read(data, trace, len(s), "unicode", limit) if len(x[2]) > 1 or x[0] != text)


def _url(s: str, limit: int) -> Iterator[Part]:
    data, trace = _percent(s)
    return _read(data, trace, len(s), "url", limit)


def _parts(text: str) -> Iterator[tuple[int, int, str, Callable[[str, int], Iterator[Part]], Trace | None]]:
    """(start, end, token, its decoder, trace of the token if it is in pieces)"""
    if "%" in text:
        yield from ((*m.span(), m.group(), _url, None) for m in _PERCENT.finditer(text))
    if "\\" in text:
        yield from ((*m.span(), m.group(), _unicode, None) for m in _UNICODE.finditer(text))
    for pieces in _pieces(text):
        at, end = pieces[0][0], pieces[-1][1]
        if len(pieces) == 1:
            yield at, end, text[at:end], _base64, None
            continue
        begin = np.array([a - at for a, _ in pieces])
        before = np.append(0, np.cumsum([b - a for a, b in pieces]))

        def joined(a: int, b: int, begin: np.ndarray = begin, before: np.ndarray = before) -> tuple[int, int]:
            i, j = (int(np.searchsorted(before[1:], x, side="right")) for x in (a, b - 1))
            return int(begin[i] + a - before[i]), int(begin[j] + b - before[j])

        yield at, end, "".join(text[a:b] for a, b in pieces), _base64, joined


def scan(text: str, max_layer: int = MAX_LAYER) -> list[tuple[str, int, int, int, str, str]]:
    """(kind, start, end, depth, encodings, sha256) of each secret, spans in characters of text."""
    found: dict[tuple, None] = {}
    work = [Layer(text, lambda a, b: (a, b), (), frozenset((hash(text),)))]
    while work:
        layer = work.pop()
        if _hinted(layer.text):
            for m in _SECRET.finditer(layer.text):
                kind = next(n for n, _ in _RULES if m.group(n) is not None)
                a, b = m.span("value") if kind == "assigned_secret" else m.span()
                digest = hashlib.sha256(layer.text[a:b].encode("utf-8", "surrogatepass")).hexdigest()
                found[(kind, *layer.origin(a, b), len(layer.path), ">".join(layer.path), digest)] = None
        for start, end, token, decode, joined in _parts(layer.text):
            try:
                for inner, trace, names in decode(token, max_layer):
                    if inner and hash(inner) not in layer.seen:
                        trace = trace if joined is None else _after(trace, joined)
                        back = _after(trace, lambda a, b, at=start, up=layer.origin: up(at + a, at + max(b, a + 1)))
                        work.append(Layer(inner, back, layer.path + names, layer.seen | {hash(inner)}))
            except Oversized:
                name = decode.__name__[1:]
                found[("oversized_layer", *layer.origin(start, end), len(layer.path) + 1, ">".join((*layer.path, name)), hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest())] = None
    return sorted(found)


def scan_secrets(docs: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """One row for each secret in docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) if (s := t.as_py()) for f in scan(s, max_layer)]
            if rows:
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
