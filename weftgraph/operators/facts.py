"""Memory facts: short records of a key, a value and tags, as items and as a graph. All in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import STORAGE_REF
from .build import complete

EMAIL = "(?i)[\\w.%+-]+@[a-z0-9.-]+\\.[a-z]{2,}"
URL = "(?i)https?://[^\\s)\\]}]+"
#: A word boundary between ASCII word signs and others, whatever the JVM's \\b takes for a letter.
_B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
DATE = _B + "\\d{4}-\\d{2}-\\d{2}" + _B
FILE = "/(?:workspace|organization)/[^\\s)\\]}]+"
REPOSITORY = _B + "[\\w.-]+/[\\w.-]+" + _B
ENTITIES = (("email", EMAIL, "mentions"), ("resource", URL, "links_to"), ("date", DATE, "mentions_date"), ("file_ref", FILE, "references_file"), ("repository", REPOSITORY, "references_repository"))
#: Under which name an entity's metadata hold it
ABOUT = {"email": "email", "resource": "href", "date": "date", "file_ref": "path", "repository": "repository"}
FACT_COLUMNS = {"id": "string", "scope": "string", "key": "string", "value": "string", "tags": "array<string>", "fact_kind": "string", "confidence": "double", "obsolete": "boolean", "last_updated_at": "string", "source_turn": "string"}


def tags_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def fact_items(facts: DataFrame) -> DataFrame:
    """Items of facts(id, scope, key, value, tags, fact_kind, ...); columns may be missing but key."""
    f = complete(facts, list(FACT_COLUMNS), FACT_COLUMNS)
    tags, kind = tags_of(F.col("tags")), F.coalesce("fact_kind", F.lit("semantic"))
    none = F.lit(None).cast("string")
    id_ = F.coalesce("id", F.concat_ws(":", F.lit("memory"), F.nullif("scope", F.lit("")), F.nullif("key", F.lit(""))))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("key")), F.nullif("value", F.lit("")), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))), F.concat(F.lit("Kind: "), kind))
    about = F.to_json(F.struct("key", "value", "scope", tags.alias("tags"), kind.alias("factKind"), "confidence", F.coalesce("obsolete", F.lit(False)).alias("obsolete"), F.col("source_turn").alias("sourceTurn")))
    ref = F.struct(F.lit("memory").alias("provider"), F.col("scope").alias("namespace"), id_.alias("physical_id"), F.col("key").alias("logical_path"), F.col("last_updated_at").alias("revision"), none.alias("permission_key"))
    return f.select(id_.alias("id"), text.alias("text"), F.col("key").alias("title"), F.lit("memory_fact").alias("source_type"), F.col("last_updated_at").alias("updated_at"), about.alias("metadata"), ref.alias("storage_ref"))


class FactProvider:
    """A provider of fact items; `changes` gives the facts updated after a cursor."""

    def __init__(self, facts: DataFrame):
        self.facts = facts

    def read(self, spark: SparkSession) -> DataFrame:
        return fact_items(self.facts)

    def changes(self, spark: SparkSession, cursor: str | None) -> DataFrame:
        items = fact_items(self.facts)
        return items if cursor is None else items.where(F.col("updated_at") > cursor)


def entity_refs(text: Column) -> Column:
    """array<struct<type, label, relation>> of the e-mails, URLs, dates, files and repositories in text."""

    def found(kind: str, pattern: str, relation: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("label"), F.lit(relation).alias("relation")))

    return F.filter(F.concat(*(found(*e) for e in ENTITIES)), lambda e: (e["type"] != "repository") | ~e["label"].contains("//"))


def extract_facts(items: DataFrame) -> DataFrame:
    """Extraction rows of fact items: the fact, its kind, tags and the entities it mentions."""
    about = F.from_json("metadata", "key string, value string, tags array<string>, factKind string, obsolete boolean")
    df = items.withColumn("_m", about)
    df = df.withColumn("_key", X.sanitize_label(F.coalesce("_m.key", "title", "id"))).withColumn("_value", X.sanitize_label(F.coalesce("_m.value", "text"), 2000))
    df = df.withColumn("_tags", tags_of(F.col("_m.tags"))).withColumn("_kind", X.sanitize_label(F.coalesce("_m.factKind", F.lit("semantic")))).withColumn("_refs", entity_refs(F.concat_ws("\n", "_key", "_value")))
    none = F.lit(None).cast("string")

    def node(id_: Column, label: Column, kind: Column, source: Column = none, path: Column = none, href: Column = none, metadata: Column = none, ref: Column | None = None) -> Column:
        return F.struct(id_.alias("id"), label.alias("label"), kind.alias("type"), source.alias("source_item_id"), none.alias("source_url"), none.alias("source_location"), path.alias("path"), href.alias("href"), none.alias("hash"), none.alias("updated_at"), metadata.alias("metadata"), (F.lit(None).cast(STORAGE_REF) if ref is None else ref).alias("storage_ref"))

    def about(kind: Column, label: Column) -> Column:
        name = F.coalesce(*[F.when(kind == k, v) for k, v in ABOUT.items()], kind)
        return F.to_json(F.create_map(name, label))

    def edge(target: Column, relation: Column, metadata: Column = none) -> Column:
        return F.struct(F.col("_fact").alias("source"), target.alias("target"), relation.alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.col("id").alias("source_item_id"), none.alias("source_location"), F.lit("memory_fact").alias("context"), metadata.alias("metadata"))

    def slug(prefix: Column, label: Column) -> Column:
        return F.concat(prefix, F.lit(":"), X.slugify(label))

    def firsts(entries: str) -> Column:
        """The first entry of each node id; the array is walked once."""
        start = F.slice(entries, 1, 0)
        return F.aggregate(entries, start, lambda acc, x: F.when(F.exists(acc, lambda y: y["node"] == x["node"]), acc).otherwise(F.concat(acc, F.array(x))))

    # whatever the item's metadata hold, with the value as it was cut and the kind of source
    more = "map('value', cast(_value as variant), 'sourceType', cast(coalesce(source_type, 'memory_fact') as variant))"
    df = df.withColumn("_about", F.expr(f"to_json(map_concat(map_filter(coalesce(from_json(metadata, 'map<string,variant>'), map()), (k, v) -> k not in ('value', 'sourceType')), {more}))"))
    df = df.withColumn("_fact", F.concat(F.lit("fact:"), F.col("id")))
    # each slug is made once and then referred to
    df = df.withColumn("_kind_id", slug(F.lit("fact_kind"), F.col("_kind")))
    df = df.withColumn("_tags", F.transform("_tags", lambda t: F.struct(t.alias("label"), slug(F.lit("tag"), t).alias("node"))))
    df = df.withColumn("_refs", F.transform("_refs", lambda r: F.struct(r["type"].alias("type"), r["label"].alias("label"), r["relation"].alias("relation"), slug(r["type"], r["label"]).alias("node"))))
    fact = node(F.col("_fact"), F.col("_key"), F.when(F.coalesce("_m.obsolete", F.lit(False)), "obsolete_memory_fact").otherwise("memory_fact"), F.col("id"), metadata=F.col("_about"), ref=F.col("storage_ref").cast(STORAGE_REF))
    tag_nodes = F.transform(firsts("_tags"), lambda t: node(t["node"], t["label"], F.lit("tag"), metadata=F.to_json(F.struct(t["label"].alias("tag")))))
    ref_nodes = F.transform(firsts("_refs"), lambda r: node(r["node"], r["label"], r["type"], path=F.when(r["type"] == "file_ref", r["label"]), href=F.when(r["type"] == "resource", r["label"]), metadata=about(r["type"], r["label"])))
    nodes = F.concat(F.array(fact, node(F.col("_kind_id"), F.col("_kind"), F.lit("fact_kind"), metadata=F.to_json(F.struct(F.col("_kind").alias("factKind"))))), tag_nodes, ref_nodes)
    edges = F.concat(F.array(edge(F.col("_kind_id"), F.lit("classified_as"))), F.transform("_tags", lambda t: edge(t["node"], F.lit("tagged_with"))), F.transform("_refs", lambda r: edge(r["node"], r["relation"], about(r["type"], r["label"]))))
    return df.select(F.col("item_seq").cast("bigint").alias("item_seq"), F.col("id").alias("item_id"), nodes.alias("nodes"), edges.alias("edges"), none.alias("error"))
