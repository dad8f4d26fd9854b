"""Every registered query against its checking SQL in an independent engine."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from entries import base
from runlens.sources.views import BASE_TABLES, VIEWS, Views, needed, portable, with_clause

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = base.QUERIES, base.CHECKS
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connection():
    engine = duckdb.connect()
    for table in BASE_TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return engine


def text(value):
    return format(value, ".9g") if isinstance(value, float) else str(value)


def compare(df, result):
    columns = sorted(df.columns)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    expected = sorted(tuple(text(row[i]) for i in places) for row in result.fetchall())
    found = sorted(tuple(text(row[c]) for c in columns) for row in df.collect())
    assert found == expected


def test_every_query_has_a_check():
    assert QUERIES.keys() == CHECKS.keys()


# No plan may pair all rows or leave the JVM.
FORBIDDEN = "CartesianProduct BroadcastNestedLoopJoin PythonUDF BatchEvalPython ArrowEvalPython MapInPandas".split()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    compare(df, connection().execute(CHECKS[name]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


# Results whose order is part of them, by the columns that fix it.
ORDERED = {
    "order_created_desc": ["created_dt"],
    "order_domain_status": ["domain_name", "status"],
    "user_notes": ["notes_skey"],
    "handover_html": ["section", "parent_run_id", "job_name"],
}


@pytest.mark.parametrize("name", ORDERED)
def test_order(spark, name):
    found = [tuple(r[c] for c in ORDERED[name]) for r in QUERIES[name](spark, SF_DIR).collect()]
    assert found and len(set(found)) > 1 or name == "user_notes"
    columns = ", ".join(ORDERED[name])
    direction = "DESC" if name in ("order_created_desc", "user_notes") else "ASC NULLS FIRST"
    order = ", ".join(f"{c} {direction}" for c in ORDERED[name])
    assert found == connection().execute(f"SELECT {columns} FROM ({CHECKS[name]}) ORDER BY {order}").fetchall()


@pytest.mark.parametrize("name", VIEWS)
def test_view(spark, name):
    known = {n: portable(sql) for n, sql in VIEWS.items()}
    clause = with_clause(needed(name, known), known)
    compare(getattr(Views(spark, SF_DIR), name), connection().execute(f"WITH {clause} SELECT * FROM {name}"))


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
