"""Text functions of the engine as Column expressions, each with a Python twin for parsers."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM = "^[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+|[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+$"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """(characters, their one-letter foldings, foldings of ligatures and digraphs) under NFKD."""
    one_from, one_to, more = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if folded == ch or not folded.isascii():
            continue
        if len(folded) == 1:
            one_from.append(ch)
            one_to.append(folded)
        elif 0x132 <= cp <= 0x1F3 or 0xFB00 <= cp <= 0xFB06:
            more[ch] = folded
    # combining marks go: translate drops characters that have no counterpart
    return "".join(one_from) + "".join(map(chr, range(0x300, 0x370))), "".join(one_to), more


def strip_diacritics(c: Column) -> Column:
    """Base letters of c; JVM-side, by a table made from Unicode's decompositions. Of the signs that
    stand for several characters, Latin digraphs and ligatures are folded, others (as Roman numerals
    in one sign) are not."""
    froms, tos, more = _folding()
    out = F.translate(c, froms, tos)
    multi = out
    for ch, folded in more.items():
        multi = F.replace(multi, F.lit(ch), F.lit(folded))
    # text of ASCII only, the usual case, passes as it is
    return F.when(F.octet_length(c) == F.char_length(c), c).when(c.rlike("[" + "".join(more) + "]"), multi).otherwise(out)


def normalize_label(c: Column) -> Column:
    """Lower-case ASCII words of c, one space apart."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(c)), "[^a-z0-9]+", " "))


def slugify(c: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(normalize_label(c), F.lit(" "), F.lit("-")), F.lit("")), F.lit("section"))


def sanitize_label(c: Column, limit: int = 256) -> Column:
    """c without control characters and outer space, at most `limit` code points; null becomes ''."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1f\\x7f]", "")
    return F.substring(F.regexp_replace(plain, _TRIM, ""), 1, limit)


def normalize_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def _last_segment(c: Column) -> Column:
    return F.substring_index(normalize_path(c), "/", -1)


def extension_of(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(_last_segment(c), "(\\.[^.]*)$", 1)), F.lit(""))


def without_extension(c: Column, fix: bool = False) -> Column:
    """The path without its extension; unless fix is set, followed by the stem once more."""
    path = normalize_path(c)
    cut = F.regexp_replace(path, "\\.[^./]*$", "")
    stem = F.regexp_replace(_last_segment(c), "\\.[^.]*$", "")
    return cut if fix else F.when(_last_segment(c).contains("."), F.concat(cut, stem)).otherwise(path)


def basename(c: Column) -> Column:
    """The last segment that isn't empty; null if there is none."""
    return F.nullif(F.regexp_extract(normalize_path(c), "([^/]+)/*$", 1), F.lit(""))


def resolve_relative_path(base: Column, target: Column) -> Column:
    """target seen from the file base: '@/' is the folder src, '.' and '..' are folded."""
    target = normalize_path(target)
    folder = F.filter(F.split(F.coalesce(normalize_path(base), F.lit("")), "/"), lambda x: x != "")
    folder = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - 1, F.lit(0)))
    steps = F.filter(F.split(target, "/"), lambda x: (x != "") & (x != "."))
    path = F.aggregate(steps, folder, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(target.startswith("@/"), F.regexp_replace(target, "^@/", "src/")).when(~target.startswith("."), target).otherwise(F.array_join(path, "/"))


def location_label(line: Column) -> Column:
    return F.when(line > 0, F.concat(F.lit("L"), line.cast("string")))


def normalize_alias(c: Column) -> Column:
    return F.replace(normalize_label(normalize_path(c)), F.lit(" "), F.lit("-"))


def inline_tags(c: Column) -> Column:
    """The words behind '#' at the start or after white space."""
    return F.regexp_extract_all(c, F.lit("(^|\\s)#([\\p{L}\\p{N}_-]+)"), F.lit(2))


def edge_weight(score: Column) -> Column:
    return F.lit(1.0) / F.greatest(F.coalesce(score, F.lit(0.5)), F.lit(0.01))


def edge_key(*extra: str) -> Column:
    """source:target:relation:source_item_id, and further columns where they are asked for."""
    return F.concat_ws(":", "source", "target", "relation", F.coalesce("source_item_id", F.lit("")), *[F.coalesce(x, F.lit("")) for x in extra])


# -- Python twins, for parsers that run in workers --

_CONTROL = re.compile("[\x00-\x1f\x7f]")
_SURROGATE = re.compile("[\ud800-\udfff]")


def py_sanitize_text(s: str | None) -> str:
    """s without unpaired surrogates (a Python string holds no paired ones)."""
    return _SURROGATE.sub("", s or "")


def py_sanitize_value(v):
    """py_sanitize_text on every string inside lists and dicts."""
    if isinstance(v, str):
        return py_sanitize_text(v)
    if isinstance(v, list):
        return [py_sanitize_value(x) for x in v]
    return {k: py_sanitize_value(x) for k, x in v.items()} if isinstance(v, dict) else v


def py_sanitize_label(s: str | None, limit: int = 256) -> str:
    return _CONTROL.sub("", py_sanitize_text(s)).strip().strip("\ufeff")[:limit]


def py_normalize_label(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def py_slugify(s: str) -> str:
    return py_normalize_label(s).replace(" ", "-") or "section"


def py_resolve_relative_path(base: str | None, target: str) -> str:
    target = target.replace("\\", "/")
    if target.startswith("@/"):
        return "src/" + target[2:]
    if not target.startswith("."):
        return target
    parts = [p for p in (base or "").replace("\\", "/").split("/") if p][:-1]
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)
