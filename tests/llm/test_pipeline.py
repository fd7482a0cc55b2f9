"""The stages of the pipeline on planted cases, and the queries with SQL against it."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from attestry.llm import queries
from tests.llm.test_operators import prose
from tests.test_catalog import DIR, TABLES, rows_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    passage = prose(500, 70)
    rows = [(k, prose(k, 150), "aa", "s", 1) for k in range(30)]
    rows += [(100, rows[3][1], "aa", "s", 1), (101, rows[4][1].replace("a", "ä", 1), "aa", "s", 1), (102, f"{prose(700, 90)} {passage} {prose(701, 90)}", None, "s", 1), (103, f"{prose(702, 90)} {passage} {prose(703, 90)}", "aa", "s", 1), (104, None, "aa", "s", 1), (105, "12345", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    by_stage = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"], name
        by_stage.append({r.doc_id: r.text for r in docs.collect()})
    language, exact, near, passages = by_stage
    assert set(language) == {r[0] for r in rows} - {104, 105}
    assert set(exact) == set(language) - {100}
    assert set(near) == set(exact) - {101}
    assert all(near[k] == passages[k] for k in range(30))
    assert set(passages) == set(near) and all(passage[20:-20] not in passages[k] and passages[k].startswith(near[k][:200]) for k in (102, 103))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(passages)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    want = con.execute(queries.oracle_sql()[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())
