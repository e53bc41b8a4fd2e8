"""Every registered job against its DuckDB oracle on the smallest fixture scale
(the driver runs the same comparison at sf0.01)."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL_SF
from worklens import registry

RAW = ["region", "nation", "customer", "supplier", "part", "events", "pages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL_SF, t + '.parquet')}')")
    return con


def _canon(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None).isoformat()
        return v

    lines = sorted(repr(tuple(norm(row[i]) for i in order)) for row in values)
    return sorted(columns), hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines)


def test_every_job_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(registry.queries()) <= set(entry.queries())


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SMALL_SF)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(entry.oracle_sql()[name])
    want_types = {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    want = _canon(list(rel.columns), rel.fetchall())
    assert got == want
    assert {f.name: f.dataType.simpleString() for f in df.schema} == want_types


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["user_name", "year_month", "number_of_days_observed"]
    assert len(df.columns) == 26
    assert df.count() > 0
