"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from attestry.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    want = duck.execute(catalog.oracle_sql()[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())


def test_issues_of_one_place_are_lines_in_order_of_code(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b" * 8001), (3, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["text"] for r in catalog.queries()["formatted_issues"](spark, str(tmp_path)).collect()}
    assert got == {1: "$ [toxic] toxic", 2: "$ [dangling_label] dangling_label\n$ [string_too_long] string_too_long", 4: "$ [toxic] toxic"}
