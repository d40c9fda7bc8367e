"""Fixtures made by hand and by a seeded generator."""

import math
import os
import random

import duckdb

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators might make for themselves.
CLASHING = ("row", "key", "rank", "size", "n", "p", "c", "chunk", "token", "_near_row", "_chain_key", "_chain_rank", "_mix_p", "_mix_source", "probability", "keep", "bucket", "g")

EN = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()
FR = "le la les des une est que dans qui pour pas sur avec plus tout mais nous comme ses elle sont leur fait cette peut aussi bien sans autre homme temps encore entre deux toujours même après monde jamais votre notre rien quand sous alors avant faire toute depuis moins celui chez ainsi pays contre années grand vers trois point mieux cela jour petit femme enfant vie rue maison chose nuit eau main coeur terre ville tête peu seul mois beaucoup trop donc lui moi voir dire venir savoir vouloir devoir prendre mettre croire".split()


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, rows):
    """rows of (doc_id, text[, lang[, source]])"""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def crowded(df):
    """df with further columns of names that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_sql(df, sql, tmp_path, table="documents"):
    """The rows of DuckDB's answer over df, in df's column order of the answer."""
    path = os.path.join(tmp_path, table)
    df.coalesce(1).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same(df, sql, source, tmp_path):
    """Whether df has the rows of sql, floats up to nine digits."""
    names, want = by_sql(source, sql, str(tmp_path))
    assert sorted(names) == sorted(df.columns)

    def clean(v):
        return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v

    have = sorted((tuple(clean(r[n]) for n in names) for r in df.collect()), key=repr)
    assert have == sorted((tuple(map(clean, r)) for r in want), key=repr)


#: What every operator over documents must bear: nulls, empty and blank texts, repeated rows, ties, a long text.
def hard_rows(rng=None):
    rng = rng or random.Random(5)
    long = prose(rng, EN, 30_000)
    same_text = prose(rng, EN, 60)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, same_text), (4, same_text), (5, same_text), (None, same_text), (None, None), (6, long), (7, "a"), (8, "!!! ??? ***"), (9, prose(rng, FR, 50), "fr"), (10, prose(rng, EN, 80), None), (11, prose(rng, EN, 90), "en", None), (12, "x" * 50_000)]
