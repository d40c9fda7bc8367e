import random

import corpus_pipeline as P
from weftgraph.llm import language_id, mixing
from weftgraph.llm.queries import oracle_sql, queries

from .helpers import EN, FR, crowded, docs, hard_rows, prose
from .test_ngram_join import brute, corpus


def rows():
    rng = random.Random(21)
    return corpus() + [(800 + i, prose(rng, FR, 80), "fr") for i in range(60)] + [(900 + i, "".join(rng.choice("qwrtzpsdfghjklyxcvbnm ") for _ in range(500)), None) for i in range(5)] + [(r[0] and r[0] + 10_000, *r[1:]) for r in hard_rows()]


def test_run_against_brute_force(spark, tmp_path):
    d = docs(spark, rows())
    d.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    packed = P.run(spark, str(tmp_path)).collect()
    # language: each document for itself, by the model of the whole table
    scorer = language_id.Scorer(language_id.fit(d))
    left = [r for r in d.collect() if scorer.decide([r.text or ""])[4][0]]
    assert not any(r.doc_id in range(900, 905) for r in left)
    # exact: the first of each text
    first = {}
    for r in sorted(left, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        first.setdefault(r.text, r)
    left = list(first.values())
    assert all(r.doc_id is not None for r in left)
    # near: the first of each group
    _, _, group = brute([(r.doc_id, r.text) for r in left])
    left = [r for r in left if group[r.doc_id] == r.doc_id]
    # mixing: the draw against the probability of the cell
    kept = {r.doc_id for r in mixing.mix(docs(spark, [(r.doc_id, r.text, r.lang, r.source) for r in left]), mixing.TARGETS).where("keep").collect()}
    words = {r.doc_id: len(r.text.split()) for r in left if r.doc_id in kept}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == words


def test_stages_keep_the_columns(spark):
    d = crowded(docs(spark, rows()))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    assert len(P.STAGES) == 5


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
