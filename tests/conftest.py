from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from worklens.sources.schemas import TABLE_SCHEMAS  # noqa: E402
from worklens.sources.tables import Tables  # noqa: E402

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from worklens.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, app_name="worklens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from worklens.sources.fixtures import fixture_tables as build

    return build(spark, SMALL_SF)


def frame(spark, table: str, rows: list[dict]):
    """A DataFrame of ``table``'s schema from dicts (missing columns are NULL)."""
    schema = TABLE_SCHEMAS[table]
    data = [tuple(r.get(f.name) for f in schema) for r in rows]
    return spark.createDataFrame(data, schema)


def empty_tables(spark, **overrides) -> Tables:
    frames = {name: frame(spark, name, []) for name in TABLE_SCHEMAS}
    frames.update(overrides)
    return Tables(**frames)


def ts(*parts) -> dt.datetime:
    return dt.datetime(*parts)


def rows(df, order=None) -> list[dict]:
    out = [r.asDict() for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[k] is None, r[k]) for k in order))
    return out
