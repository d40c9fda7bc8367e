"""Sources of items: tables, lists, folders, facts, converted records and change feeds."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.build import complete
from ..schema import ITEM, STORAGE_REF

COLUMNS = [c.split()[0] for c in re.sub(r"struct<[^>]*>", "struct", ITEM).split(", ")]
EXTENSIONS = tuple(f".{x}" for x in "txt md mdx json yaml yml js cjs mjs jsx ts tsx".split())
IGNORED = (".git", ".next", ".env*", "coverage", "dist", "node_modules", "weftgraph-out", "pnpm-lock.yaml", "bun.lockb", "package-lock.json", "yarn.lock", "**/*.tsbuildinfo")
IGNORE_FILE = ".weftgraphignore"


def normalize(items: DataFrame, order: str | None = None) -> DataFrame:
    """items(id, text, ...) with every item column: paths with '/', defaults, and item_seq. The order
    is that of column `order`, of item_seq if the items have one, or of id."""
    if order is not None:
        items = items.withColumn("item_seq", F.col(order).cast("bigint"))
    known = complete(items, [c for c in COLUMNS if c in items.columns or c != "item_seq"], {"storage_ref": STORAGE_REF})
    ref = F.struct(F.coalesce("source_type", F.lit("memory")).alias("provider"), *[F.lit(None).cast("string").alias(x) for x in ("namespace", "physical_id")], X.normalize_path(F.col("path")).alias("logical_path"), *[F.lit(None).cast("string").alias(x) for x in ("revision", "permission_key")])
    known = known.withColumn("path", X.normalize_path(F.col("path"))).withColumn("storage_ref", F.coalesce("storage_ref", ref)).withColumn("source_type", F.coalesce("source_type", F.lit("text"))).withColumn("id", F.col("id").cast("string"))
    if "item_seq" not in items.columns:
        known = _numbered(known)
    return known.select(*COLUMNS)


def _numbered(items: DataFrame) -> DataFrame:
    """item_seq that grows with id: the partitions are ranges of ids, sorted, and numbers
    grow over partitions, so no task sees all rows."""
    return items.repartitionByRange("id").sortWithinPartitions("id").withColumn("item_seq", F.monotonically_increasing_id())


def permitted(items: DataFrame, allow: Column | Callable[[dict], bool] | None) -> DataFrame:
    """The items that a condition, or a Python predicate of an item as dict, allows."""
    if allow is None:
        return items
    if isinstance(allow, Column):
        return items.where(allow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(allow(x)) for x in batch.to_pylist()], type=pa.bool_()))

    return items.mapInArrow(run, items.schema)


def collect_items(spark: SparkSession, source, allow: Column | Callable[[dict], bool] | None = None, order: str | None = None) -> DataFrame:
    """Items from a folder's path, a DataFrame, one dict, an iterable of dicts or a provider: an object
    with `read(spark)` that returns a DataFrame."""
    if isinstance(source, str):
        df = local_files(spark, source)
    elif isinstance(source, DataFrame):
        df = normalize(source, order)
    elif hasattr(source, "read"):
        df = normalize(source.read(spark), order)
    elif isinstance(source, dict):
        df = normalize(from_records(spark, [source]))
    elif isinstance(source, Iterable):
        df = normalize(from_records(spark, source))
    else:
        raise TypeError(f"no items can be read from {type(source).__name__}")
    return permitted(df, allow)


def from_records(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    """A DataFrame of dicts in their order."""
    rows = []
    for i, r in enumerate(records):
        row = {k: r.get(k) for k in COLUMNS if k not in ("item_seq", "storage_ref")}
        row["id"], row["text"] = X.py_sanitize_text(str(r["id"])), X.py_sanitize_text(r.get("text"))
        if row["metadata"] is not None and not isinstance(row["metadata"], str):
            row["metadata"] = json.dumps(X.py_sanitize_value(row["metadata"]), ensure_ascii=False)
        rows.append(tuple(row[k] for k in row) + (i,))
    names = [k for k in COLUMNS if k not in ("item_seq", "storage_ref")]
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in names) + ", item_seq bigint")


class TableProvider:
    """Items from a table on storage; `changes` gives those updated after a cursor."""

    def __init__(self, path: str, columns: dict[str, str], format: str = "parquet"):
        self.path, self.columns, self.format = path, columns, format

    def read(self, spark: SparkSession) -> DataFrame:
        df = spark.read.format(self.format).load(self.path)
        return df.select(*[df[c].alias(k) for k, c in self.columns.items()])

    def changes(self, spark: SparkSession, cursor: str | None) -> DataFrame:
        df = self.read(spark)
        return df.where(F.col("updated_at") > cursor) if cursor is not None else df


def changed_items(spark: SparkSession, provider, cursor: str | None, allow=None) -> DataFrame:
    """A provider's items since cursor; all of them if it keeps no changes."""
    df = provider.changes(spark, cursor) if hasattr(provider, "changes") else provider.read(spark)
    return permitted(normalize(df), allow)


def ignored(path: str, patterns: Iterable[str]) -> bool:
    """Whether ignore patterns cover a relative path: the last that matches decides, '!' takes back."""
    parts, out = PurePosixPath(path).parts, False
    for raw in patterns:
        pattern = raw.rstrip()
        if not pattern or pattern.startswith("#"):
            continue
        keep = pattern.startswith("!")
        pattern = pattern.lstrip("!")
        folder, rooted = pattern.endswith("/"), "/" in pattern.rstrip("/")
        pattern = pattern.strip("/")
        heads = ["/".join(parts[: i + 1]) for i in range(len(parts) - (1 if folder else 0))]
        names = heads if rooted else list(parts[: len(parts) - (1 if folder else 0)])
        globs = {pattern, pattern.replace("**/", ""), pattern.replace("/**", "/*")}
        if any(fnmatch.fnmatchcase(n, g) for n in names for g in globs):
            out = not keep
    return out


def _read_hidden(spark: SparkSession, path: str) -> str:
    """The text of a file whose name begins with a dot, which readers skip; '' if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def local_files(spark: SparkSession, root: str, extensions: Iterable[str] = EXTENSIONS, ignore_file: str = IGNORE_FILE, additional: Iterable[str] = ()) -> DataFrame:
    """Items of the text files under root, by Spark's binary reader: id is the relative path."""
    base = root.rstrip("/")
    patterns = [*IGNORED, *additional]
    patterns += _read_hidden(spark, f"{base}/{ignore_file}").splitlines()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(extensions) + "}").load(base)
    clean = F.regexp_replace("path", "^[a-z]+:/+", "/")
    prefix = re.sub("^[a-z]+:/+", "/", base) + "/"
    rel = F.regexp_replace(F.url_decode(F.replace(clean, F.lit("+"), F.lit("%2B"))), "^" + re.escape(prefix), "")

    @F.pandas_udf("boolean")
    def dropped(paths: pd.Series) -> pd.Series:
        return paths.map(lambda path: ignored(path, patterns)).astype(bool)

    text = F.decode("content", "UTF-8")
    files = files.select(rel.alias("rel"), text.alias("text"), "content", "modificationTime", clean.alias("full")).where(~F.col("rel").rlike("(^|/)\\.") & ~dropped("rel"))
    none = F.lit(None).cast("string")
    ref = F.struct(F.lit("local").alias("provider"), none.alias("namespace"), F.col("full").alias("physical_id"), F.col("rel").alias("logical_path"), none.alias("revision"), none.alias("permission_key"))
    return normalize(files.select(F.col("rel").alias("id"), "text", X.basename(F.col("rel")).alias("title"), F.col("rel").alias("path"), F.lit("local-file").alias("source_type"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"), F.sha2("content", 256).alias("hash"), ref.alias("storage_ref")))


def converted(records: DataFrame, convert: Callable[[str], str] | Column, input_column: str = "input") -> DataFrame:
    """Items of records(id, input, title, path, url, metadata) whose text a converter makes."""
    if isinstance(convert, Column):
        return records.withColumn("text", convert).drop(input_column)

    @F.pandas_udf("string")
    def run(values):
        return values.map(convert)

    return records.withColumn("text", run(F.col(input_column))).drop(input_column)


class ConvertedProvider:
    """A provider of records whose text a converter makes when they are read."""

    def __init__(self, records: DataFrame, convert: Callable[[str], str] | Column, input_column: str = "input"):
        self.records, self.convert, self.input_column = records, convert, input_column

    def read(self, spark: SparkSession) -> DataFrame:
        return converted(self.records, self.convert, self.input_column)
