"""Every registered query with SQL, side by side with DuckDB on the small tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("q_") and n not in entry.oracle_sql()))
def test_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    said = plan(entry.queries()["q_project_filter"](spark, sf))
    assert "GreaterThan(l_quantity,49.0)" in said and "l_comment" not in said and "l_tax" not in said
    said = plan(entry.queries()["q_list_bounds"](spark, sf))
    assert "EqualTo(lang,en)" in said


@pytest.mark.parametrize("name", ["q_find_by_tag_index", "q_garbage_chunks", "q_replication_rules", "q_ranges_merge", "q_ranges_diff"])
def test_no_cross_join_and_no_python(spark, sf, name):
    said = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in said and "BroadcastNestedLoopJoin" not in said and "Python" not in said and "Pandas" not in said
