"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed over all documents in cells of source, language and topic. Raking
scales the cells in turn until the sums by source, by language and by topic meet their targets. The cell
factor, capped at keeping everything, is the probability at which a document of the cell stays: the
caps and the scale of the rest are solved together so that the expected kept tokens are
`fraction` of the corpus. A document's draw is a hash of its doc_id, so a rerun, a retried task
or another engine takes the same sample.

The cells are few beside the documents, yet their number can grow with the sources, so raking and
capping are plans over the cell table rather than driver loops over collected rows; the join back
to documents is left to the planner (broadcast only if measured small).

Targets: `targets[dimension]` maps values to weights, with what is not named sharing the rest in
proportion to its tokens; without targets a dimension aims at tokens ** exponent, which flattens it. The query and the
pipeline use `TARGETS` for language and topic and the exponent for source. A value whose target is 0 stays out.
A document's topic is its column `topic`, where there is one, else that of the first rule that its text meets.

Edge cases: targets that leave all of a value's cells without weight give it nothing, whatever its own target; null source, language or text are the value ''; a document without words is in no
cell's sum and stays with its cell's probability; equal doc_ids draw alike, so repeated rows
stay or go together; a null doc_id draws like ''; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, shared_dir

DIMENSIONS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: Target weights; what isn't named shares the rest
TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.1}, "topic": {"license": 0.02, "table": 0.02, "listing": 0.02, "shout": 0.01}}
ROUNDS = 12
FRACTION = 0.7
#: The first rule that a text meets names its topic.
TOPICS = (("license", "(?i)licen[sc]e|copyright"), ("table", " \\| "), ("listing", "[*$%&#]{3}"), ("shout", "[A-Z]{2,}!!"))


def topic_of(docs: DataFrame) -> Column:
    text = F.col("text")
    rule = reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), TOPICS[1:], F.when(text.rlike(TOPICS[0][1]), TOPICS[0][0]))
    rule = F.coalesce(rule.otherwise("prose"), F.lit("prose"))
    return F.coalesce(F.col("topic").cast("string"), rule) if "topic" in docs.columns else rule


def tokens_of(text: Column) -> Column:
    """Words: the places where a run of other characters than space, tab and line ends begins."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def draw(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) with tokens > 0."""
    parts = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(docs).alias("topic"), tokens_of(F.col("text")).alias("t"))
    return parts.groupBy(*DIMENSIONS).agg(F.sum("t").cast("double").alias("tokens")).where("tokens > 0")


def target_of(table: DataFrame, dimension: str, targets: dict[str, dict[str, float]] | None, exponents: dict[str, float]) -> Column:
    """Target share of a row's value in a dimension, as a column over the cell table."""
    here, whole = W.partitionBy(dimension), W.partitionBy(F.lit(0))
    mass = F.sum("tokens").over(here)
    given = (targets or {}).get(dimension)
    if given:
        named = F.col(dimension).isin(list(given))
        rest = max(0.0, 1.0 - sum(given.values()))
        free = F.sum(F.when(named, 0.0).otherwise(F.col("tokens"))).over(whole)
        value = reduce(lambda c, kv: c.when(F.col(dimension) == kv[0], float(kv[1])), given.items(), F.when(F.lit(False), 0.0))
        return F.when(named, value.otherwise(0.0)).otherwise(rest * mass / free)
    power = F.pow(mass, F.lit(exponents[dimension]))
    return power / F.sum(power * F.col("tokens") / mass).over(whole)


def rake(table: DataFrame, targets: dict[str, dict[str, float]] | None = None, exponents: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Adds weight: each cell's share of the raked corpus."""
    exponents = EXPONENTS | (exponents or {})
    shared_dir(table.sparkSession)  # where the checkpoints go
    # one row a cell: one partition holds it, and the windows below need no exchange
    table = table.coalesce(1).checkpoint()
    for d in DIMENSIONS:
        table = table.withColumn(f"to_{d}", target_of(table, d, targets, exponents))
    table = table.withColumn("weight", F.col("tokens") / F.sum("tokens").over(W.partitionBy(F.lit(0)))).checkpoint()
    for i in range(rounds):
        for d in DIMENSIONS:
            held = F.sum("weight").over(W.partitionBy(d))
            table = table.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"to_{d}") / held).otherwise(0.0))
        if i % 4 == 3:
            table = table.checkpoint()
    held = F.sum("weight").over(W.partitionBy(F.lit(0)))
    return table.withColumn("weight", F.when(held > 0, F.col("weight") / held).otherwise(0.0))


def probabilities(raked: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """(source, lang, topic, p) with p = min(1, scale * weight / tokens), and the scale such that
    the sum of p * tokens is `fraction` of all tokens."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("factor"), *DIMENSIONS)
    whole = W.partitionBy(F.lit(0))
    # factor is rounded where it orders, so that cells tied but for summation order stay tied
    t = raked.withColumn("factor", F.col("weight") / F.col("tokens")).withColumn("budget", fraction * F.sum("tokens").over(whole))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("scale", F.when(F.col("factor") > 0, (F.col("budget") - F.coalesce(F.sum("tokens").over(before), F.lit(0.0))) / after))
    # the first cell, in falling order of factor, that its scale leaves uncapped sets the scale
    scale = F.max(F.when(F.col("scale") * F.col("factor") <= 1.0, F.struct(F.col("factor"), F.col("scale")))).over(whole)["scale"]
    p = F.when(F.col("factor") > 0, F.least(F.coalesce(F.col("s") * F.col("factor"), F.lit(1.0)), F.lit(1.0))).otherwise(0.0)
    return t.withColumn("s", scale).select(*DIMENSIONS, p.alias("p"))


def _drawn(docs: DataFrame, targets, fraction: float, rounds: int) -> tuple[DataFrame, dict[str, str], str]:
    p = probabilities(rake(cells(docs), targets, None, rounds), fraction).checkpoint()
    names = {d: fresh(docs, f"_mix_{d}") for d in DIMENSIONS}
    prob = fresh(docs, "_mix_p")
    p = p.select(*[F.col(d).alias(names[d]) for d in DIMENSIONS], F.col("p").alias(prob))
    marked = docs.withColumns({names["source"]: F.coalesce("source", F.lit("")), names["lang"]: F.coalesce("lang", F.lit("")), names["topic"]: topic_of(docs)})
    if p.count() <= 100_000:  # some 100 bytes a cell
        p = F.broadcast(p)
    joined = marked.join(p, list(names.values()), "left").withColumn(prob, F.coalesce(prob, F.lit(1.0)))
    return joined, names, prob


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, topic, probability, keep) for each document."""
    joined, names, p = _drawn(docs, targets, fraction, rounds)
    return joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(names["topic"]).alias("topic"), F.round(p, 9).alias("probability"), (draw(F.col("doc_id")) < F.col(p)).alias("keep"))


def sample_mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS) -> DataFrame:
    """The documents that the mix keeps, with all their columns."""
    joined, _, p = _drawn(docs, targets, fraction, rounds)
    return joined.where(draw(F.col("doc_id")) < F.col(p)).select(docs.columns)


def oracle(targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS) -> str:
    rule = " ".join(f"WHEN regexp_matches(text, '{r}') THEN '{n}'" for n, r in TOPICS)
    steps, last = [], "w0"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"w{len(steps) + 1}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * to_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0) AS weight) FROM {last})")
            last = name

    def given(d: str) -> dict[str, float]:
        return (targets or {}).get(d) or {}

    def named(d: str) -> str:
        return f"{d} IN ({', '.join(repr(k) for k in given(d))})"

    def to(d: str) -> str:
        if not given(d):
            return f"q_{d} / sum(q_{d} * tokens / m_{d}) OVER () AS to_{d}"
        cases = " ".join(f"WHEN {d} = {k!r} THEN {float(v)}" for k, v in given(d).items())
        return f"(CASE {cases} ELSE {max(0.0, 1.0 - sum(given(d).values()))!r} * m_{d} / sum(CASE WHEN {named(d)} THEN 0.0 ELSE tokens END) OVER () END)::DOUBLE AS to_{d}"

    pow_ = {d: f"pow(sum(tokens) OVER (PARTITION BY {d}), {EXPONENTS[d]})" for d in DIMENSIONS}
    to0 = ", ".join(f"{pow_[d]} AS q_{d}, sum(tokens) OVER (PARTITION BY {d}) AS m_{d}" for d in DIMENSIONS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {rule} ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS t FROM documents),
c AS (SELECT source, lang, topic, sum(t)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(t) > 0),
t0 AS (SELECT *, {to0} FROM c), w0 AS (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS weight, {", ".join(map(to, DIMENSIONS))} FROM t0),
{", ".join(steps)},
n AS (SELECT source, lang, topic, tokens, coalesce(weight / nullif(sum(weight) OVER (), 0), 0) AS weight FROM {last}),
f AS (SELECT *, weight / tokens AS factor, {fraction} * sum(tokens) OVER () AS budget FROM n),
s AS (SELECT *, CASE WHEN factor > 0 THEN (budget - coalesce(sum(tokens) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS scale FROM f),
p AS (SELECT source, lang, topic, CASE WHEN factor > 0 THEN least(coalesce((SELECT arg_max(scale, factor) FROM s WHERE scale * factor <= 1.0) * factor, 1.0), 1.0) ELSE 0.0 END AS p FROM s)
SELECT doc_id, topic, round(coalesce(p, 1.0), 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(p, 1.0) AS keep
FROM d LEFT JOIN p USING (source, lang, topic)"""
