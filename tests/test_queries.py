"""Every registered query of the retrieval engine against its SQL."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest

from shotline.plans.catalog import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name].replace("/root/testdata/sf0.01", SF))
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    at = [sql.columns.index(n) for n in names]
    assert sorted("|".join(plain(r[n]) for n in names) for r in df.collect()) == sorted("|".join(plain(r[k]) for k in at) for r in sql.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_flagship(spark):
    """Twenty frames for each query: every row whose id is divisible by 50."""
    rows = flagship(spark, SF).collect()
    assert {r.query_id for r in rows} == set(range(0, 500, 50)) and len(rows) == 200


def test_no_query_cuts_texts_or_ids():
    """No prefix of a text, id subset or modulo filter thins an input table, in Spark or SQL."""
    for sql in ORACLE_SQL.values():
        assert not re.search(r"text\[1:(?!700|20)|doc_id <|in \(0, 7, 42\)", sql)


def test_top_k_is_a_prefix(spark):
    from shotline.operators import vector
    from shotline.sources import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF)
    few, more = ({(r.query_id, r.model, r.rank, r.frame_id) for r in vector.top_k(v, q, k).collect()} for k in (5, 12))
    assert few == {r for r in more if r[2] <= 5}


def test_point_lookup_reaches_the_scan(spark, capsys):
    from shotline.operators import vector

    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id as frame_id", "'a' as model", "embedding")
    vector.lookup(e, 5, "a").explain()
    assert "EqualTo(vec_id,5)" in capsys.readouterr().out
