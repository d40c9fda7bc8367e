"""Helpers shared by the training-data operators: scratch tables on shared storage, Arrow
batches cut into chunks of whole texts, and character classes for language models."""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Characters held decoded at once. A longer text makes a chunk of its own, so none is cut.
CHUNK_CHARS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder that the context was given. Where
    neither is set, a folder of our own on a single machine, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + os.path.join(tempfile.gettempdir(), f"weftgraph-{os.getuid()}")
    context.setCheckpointDir(base)
    return base


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weftgraph/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Deletes what this application's operators wrote to shared storage; their results can't be read any more."""
    delete(spark, _scratch(spark))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise df as Parquet on shared storage and read it back: lineage is cut and a lost
    executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use, whatever columns the caller brings along."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) with None read as empty; at most `limit` characters a chunk
    unless one text is longer."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield at, i, part
            at, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield at, len(texts), part


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=4)
def class_table(width: int, fold: bool) -> np.ndarray:
    """Character class by code point of the BMP: 0 for all but letters, 1-26 for a-z, the
    other letters by code point over the classes that are left. fold strips accents first."""
    out = np.zeros(65536, dtype=np.uint8)
    rest = width - 27
    for cp in range(65536):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        low = ch.lower()
        if fold:
            low = unicodedata.normalize("NFKD", low)
        a = ord(low[0])
        out[cp] = a - 96 if 97 <= a <= 122 else 27 + a % rest if rest else 0
    return out


def grams(texts: list[str], width: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character 4-grams of some texts and the index where each text's begin.

    Runs of other characters than letters become one boundary (class 0); a context never
    reaches across a boundary, so a 4-gram is padded with zeros at a word's start."""
    cp = code_points("\n".join(texts) + "\n")
    table = class_table(width, fold)
    if len(cp) and cp.max() > 0xFFFF:
        cls = np.where(cp > 0xFFFF, 27 + cp % max(1, width - 27) if width > 27 else 0, table[np.minimum(cp, 0xFFFF)]).astype(np.int32)
    else:
        cls = table[cp].astype(np.int32)
    keep = cls != 0
    keep[1:] |= cls[:-1] != 0
    keep[:1] = cls[:1] != 0
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    kept = np.cumsum(keep)
    starts = np.zeros(len(texts), dtype=np.int64)
    starts[1:] = kept[ends[:-1] - 1]
    c = cls[keep]
    z1 = np.zeros_like(c)
    z1[1:] = c[:-1]
    z2 = np.zeros_like(c)
    z2[2:] = c[:-2]
    z2[z1 == 0] = 0
    z3 = np.zeros_like(c)
    z3[3:] = c[:-3]
    z3[z2 == 0] = 0
    return ((z3 * width + z2) * width + z1) * width + c, starts


def segment_sums(values: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]], empty segments giving 0."""
    acc = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=acc[1:], dtype=np.float64)
    ends = np.append(starts[1:], total)
    return acc[ends] - acc[starts]
