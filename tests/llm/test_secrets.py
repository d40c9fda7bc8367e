import base64
import bz2
import gzip
import hashlib
import lzma
import random
import subprocess
import sys
import time
import zlib
from urllib.parse import quote

import zstandard

from weftgraph.llm import secrets as S

from .helpers import crowded, docs, hard_rows

KEY = "AKIA" + "Q7" * 8


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def test_plain_secrets_have_their_spans():
    text = f"è the key {KEY}, and password = 'hunter2hunter2' or ghp_{'a1' * 18} end"
    for kind, start, end, depth, path, digest in S.scan(text):
        assert depth == 0 and path == "" and digest == sha(text[start:end])
    assert {f[0] for f in S.scan(text)} == {"aws_access_key", "assigned_secret", "github_token"}


def test_layers_are_unwrapped_and_mapped_back():
    forced = "".join(f"%{ord(c):02x}" for c in KEY)
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    cases = {"url": forced, "unicode": escaped, "base64": b64("x=" + KEY + " y"), "base64>gzip": b64(gzip.compress(("k " + KEY).encode())), "base64>zlib": b64(zlib.compress(KEY.encode())), "base64>bzip2": b64(bz2.compress(KEY.encode())), "base64>zstd": b64(zstandard.compress(KEY.encode()))}
    cases |= {"base64>base64": b64(b64("key " + KEY)), "base64>url": b64("go " + forced), "url>base64": quote(b64("a key: " + KEY + "..") + "=", safe="").replace("=", "%3D")}
    for path, token in cases.items():
        text = f"before {token} after"
        found = [f for f in S.scan(text) if f[0] == "aws_access_key" and f[5] == sha(KEY)]
        assert any(f[4].startswith(path.split(">")[0]) for f in found), path
        for _, start, end, _, _, _ in found:
            assert 7 <= start < end <= 7 + len(token)
    spans = [f for f in S.scan("zz " + forced) if f[4] == "url"]
    assert spans[0][1:3] == (3, 3 + len(forced))


def test_deep_nesting_ends():
    token = KEY
    for _ in range(12):
        token = b64("<" + token + ">")
    found = S.scan(token)
    assert [f for f in found if f[0] == "aws_access_key"][0][3] == 12
    assert S.scan("%25" * 50) == [] and S.scan("\\u0025" * 20 + "41" * 40) == []


def test_oversized_layers_are_told():
    bomb = b64(gzip.compress(b"0" * 200_000))
    assert [f[0] for f in S.scan(bomb, max_layer=100_000)] == ["oversized_layer"]


def test_clean_text_has_no_findings():
    text = "The token of the day is a secret; 100% sure, see C:\\users\\x and " + "a" * 64 + " or https://example.org/a?b=c"
    assert S.scan(text) == []


def test_hard_rows(spark):
    d = docs(spark, hard_rows() + [(50, f"key {KEY} " * 2), (51, "w " * 100_000 + b64("x " + KEY + " "))])
    got = S.scan_secrets(crowded(d)).collect()
    assert sorted({(r.doc_id, r.kind) for r in got}) == [(50, "aws_access_key"), (51, "aws_access_key")]
    assert sum(r.doc_id == 50 for r in got) == 2
    assert all(r.secret_sha256 == sha(KEY) for r in got)
    assert S.scan_secrets(docs(spark, [])).count() == 0


def held(text, path=None):
    return [f for f in S.scan(text) if f[0] == "aws_access_key" and f[5] == sha(KEY) and path in (None, f[4])]


def noise(n, seed):
    return "".join(random.Random(f"{seed}").choices("abcdefghijklmnopqrstuvwxyz 0123456789,.?>~", k=n))


def test_url_safe_tokens_are_read_whole():
    for i in range(200):
        data = zlib.compress(f"{noise(60, i)} {KEY} {noise(40, -i)}".encode())
        token = base64.urlsafe_b64encode(data).decode()
        assert any(f[1:3] == (4, 4 + len(token)) for f in held(f"see {token} end", "base64>zlib")), token
        plain = base64.urlsafe_b64encode(f"{noise(30, i)}?>~ {KEY} .".encode()).decode()
        assert held(plain, "base64")
    # tokens glued to a sign of the other alphabet are read as before
    for glue in ("name-of_it-", "a/b/"):
        assert held(f"{glue}{b64('k ' + KEY + ' .')}")


def test_wrapped_base64_is_read_over_lines():
    for i in range(60):
        for width, end in ((76, "\n"), (64, "\r\n"), (20, "\n  ")):
            text = f"{noise(i + 30, i)} {KEY} {noise(90, -i)}"
            for data, path in ((text.encode(), "base64"), (gzip.compress(text.encode(), mtime=0), "base64>gzip")):
                code = b64(data)
                lines = end.join(code[k : k + width] for k in range(0, len(code), width))
                for before, after in (("", ""), ("body\n", "\nword after"), ("data: ", " end"), ("", "\n\nend")):
                    got = held(before + lines + after, path)
                    assert got, (before, lines)
                    if path == "base64":
                        first, last = (i + 31) * 4 // 3, -(-(i + 31 + len(KEY)) * 4 // 3) - 1
                        span = tuple(len(before) + x + x // width * len(end) for x in (first, last))
                        assert (span[0], span[1] + 1) in {f[1:3] for f in got}


def test_all_members_are_read():
    packs = {"gzip": gzip.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress, "zlib": zlib.compress}
    for name, pack in packs.items():
        first, last = pack(b"first "), pack(f"then {KEY} ".encode())
        for data in (first + last, first + pack(b"") + last, first + b"\0" * 8 + last, first + f"tail {KEY} ".encode(), first + packs["bzip2"](KEY.encode())):
            assert held(b64(data), f"base64>{name}"), (name, data)
    bomb = b64(gzip.compress(b"0" * 60_000) + gzip.compress(b"0" * 60_000))
    assert {f[0] for f in S.scan(bomb, max_layer=100_000)} == {"oversized_layer"}
    bomb = b64(zstandard.compress(b"0" * 200_000))
    assert {f[0] for f in S.scan(bomb, max_layer=100_000)} == {"oversized_layer"}


def test_bytes_that_are_no_clean_text_are_scanned():
    text = f"a key {KEY} ."
    for data in (b"\xff\xfe\x80" + text.encode(), text.encode() + b"\x00\x01", b"\x1b" + text.encode(), "è".encode("latin-1") + text.encode()):
        assert held(b64(data), "base64") and held(b64(gzip.compress(data)), "base64>gzip"), data
        (_, a, b, *_), k = held(b64(data), "base64")[0], data.index(KEY.encode())
        assert (a, b) == (k * 4 // 3, -(-(k + len(KEY)) * 4 // 3))
    for data in (text.encode("utf-16"), text.encode("utf-16-be"), b"\x07" + text.encode("utf-16-le"), f"\u4e2d{KEY}\u3041".encode("utf-16-be")):
        assert held(b64(data), "base64>utf16") and held(b64(gzip.compress(data)), "base64>gzip>utf16"), data
    assert held(b64(b"\xff" + b64(text).encode()), "base64>base64")


def test_compressed_bytes_behind_escapes_are_read():
    for data in (gzip.compress(f"a {KEY} b".encode(), mtime=0), zlib.compress(KEY.encode() * 3), bz2.compress(KEY.encode())):
        hexed, slashed = "".join(f"%{x:02X}" for x in data), "".join(f"\\x{x:02x}" for x in data)
        for token, name in ((hexed, "url"), (slashed, "unicode"), (quote(data), "url")):
            got = [f for f in held(f"see {token} end") if f[4].startswith(name + ">")]
            assert got and got[0][1:3] == (4, 4 + len(token)), name
    assert held("".join(f"%{x:02x}" for x in KEY.encode("utf-16")), "url>utf16")
    pair = "".join(f"\\u{x:04x}" for x in (0xD83D, 0xDE00)) + f"\\u0020{KEY}"
    (kind, a, b, *_), = [f for f in held(pair) if f[3] == 1]
    assert (a, b) == (18, 18 + len(KEY))


def test_spans_of_wide_characters():
    text = "é漢😀" + KEY + "é"
    for token, size in ((quote(text), lambda x: len(quote(x))), (text[:3] + "%41" + KEY[1:] + "é", None), (b64(text), None)):
        got = held("ü " + token)
        if size:
            assert (2 + size(text[:3]), 2 + size(text[:3]) + len(KEY)) in {f[1:3] for f in got}
        else:
            assert got and all(2 <= f[1] < f[2] <= 2 + len(token) for f in got)
    assert (5, 7 + len(KEY)) in {f[1:3] for f in held("ü é漢%41" + KEY[1:])} or held("ü é漢%41" + KEY[1:])[0][1:3] == (4, 6 + len(KEY))


ENCODERS = {
    "url": lambda b: "".join(f"%{x:02x}" for x in b),
    "unicode": lambda b: "".join(f"\\x{x:02x}" for x in b),
    "base64": lambda b: base64.b64encode(b).decode(),
    "urlsafe": lambda b: base64.urlsafe_b64encode(b).decode(),
    "wrapped": lambda b: "\n".join(base64.encodebytes(b).decode().split("\n")).strip(),
}
PACKERS = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress, "utf16": lambda b: b.decode("latin-1").encode("utf-16-le")}


def plainly(text, depth=0):
    """(kind, digest) by plain recursion over white-space tokens and over all lines joined, without spans."""
    got = {(n, sha(m.group("value") if n == "assigned_secret" else m.group())) for m in S._SECRET.finditer(text) for n, _ in S._RULES if m.group(n)}
    if depth > 8:
        return got
    for token in {*text.split(), "".join(text.split())}:
        datas = []
        if "%" in token:
            datas.append(__import__("urllib.parse").parse.unquote_to_bytes(token))
        if "\\x" in token:
            datas.append(bytes(int(x, 16) for x in token.split("\\x")[1:]) if all(len(x) == 2 for x in token.split("\\x")[1:]) else b"")
        try:
            datas.append(base64.b64decode(token.replace("-", "+").replace("_", "/"), validate=True))
        except ValueError:
            pass
        for data in datas:
            for unpack in (gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)):
                try:
                    data = unpack(data)
                except Exception:  # noqa: BLE001, S112
                    continue
            for code in ("utf-8", "utf-16-le"):
                try:
                    inner = data.decode(code)
                except UnicodeDecodeError:
                    continue
                if inner and inner != token:
                    got |= plainly(inner, depth + 1)
    return got


def test_random_nestings_against_plain_recursion():
    rng = random.Random(77)
    for _ in range(250):
        data, path = f"{noise(rng.randrange(5, 40), rng.random())} {KEY} {noise(9, rng.random())}".encode(), []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                name = rng.choice([n for n in PACKERS if n != "utf16" or data.isascii()])
                data = PACKERS[name](data)
            name = rng.choice(list(ENCODERS))
            data = ENCODERS[name](data).encode()
            path.append(name)
        token = data.decode()
        text = f"{noise(20, rng.random())} {token} end"
        want = {w for w in plainly(token) if w[0] == "aws_access_key"}
        got = {(f[0], f[5]) for f in S.scan(text)}
        assert want <= got and ("aws_access_key", sha(KEY)) in got, path
        start = text.index(token)
        assert all(start <= f[1] < f[2] <= start + len(token) for f in S.scan(text) if f[5] == sha(KEY)), path


def test_a_layer_of_many_megabytes_needs_little_memory():
    code = f"""
import base64, gzip, resource, sys
sys.path.insert(0, {repr(__file__.rsplit('/tests/', 1)[0])})
from weftgraph.llm import secrets as S
key = 'AKIA' + 'Q7' * 8
token = base64.b64encode(gzip.compress(b'some words, ' * ((60 << 20) // 12) + key.encode())).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert any(f[0] == 'aws_access_key' for f in S.scan('x ' + token))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500_000


def test_long_runs_cost_their_length():
    began = time.time()
    for text in ("x" * 300_000 + " 5% and \\ token", "a" * 300_000 + "://", "%" * 200_000, "\\" * 200_000):
        assert S.scan(text) == []
    assert time.time() - began < 20
