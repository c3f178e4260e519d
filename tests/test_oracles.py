"""Every registered query against its DuckDB oracle on the driver tables
(row count, column names, order-insensitive value hash)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re

import duckdb
import pytest

from testpaths import SF_SMALL

import __spark_entry__ as E
from colloquy.sources.tables import DRIVER_TABLES

QUERIES = E.queries()
SQL = E.oracle_sql()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    missing = sorted(q for q in set(QUERIES) - set(SQL) if not re.match(r"op\d+_|pipeline$", q))
    assert missing == [], f"queries without SQL oracle: {missing}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == {d[0]: str(d[1]) for d in cur.description}
    assert len(srows) == len(drows)
    assert canon(df.columns, srows) == canon(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["meeting_id", "title", "call_type", "overall_sentiment_score",
                          "pct_neg_start", "pct_pos_end", "resolution_shift"]
    assert len(rows) > 0
