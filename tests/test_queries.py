"""Every query of the catalogue against its SQL on the small tables."""

import math

import duckdb
import pytest

from tracefold.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return round(float(v), 8) + 0.0
    except (TypeError, ValueError):
        return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(set(df.columns)) == len(df.columns)
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, got.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hash_join_is_no_cartesian_product(spark, sf):
    from tracefold.plans.catalogue_matching import _hits, _pairs

    for df in (_hits(spark, sf), _pairs(spark, sf)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_shortlist_limits_below_the_exchange(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["q23_cosine_topk20"](spark, sf))


def test_scan_reads_only_the_columns_used(spark, sf):
    text = plan(QUERIES["q02_chord_ngram_df"](spark, sf))
    assert "props" not in text
