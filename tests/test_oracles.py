"""Registered queries against their SQL on the smallest supplied tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as spec
from check_oracles import connect, differences
from conftest import SMALL


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(spec.oracle_sql()) <= set(spec.queries())


def test_entry(spark):
    rows = spec.entry(spark).collect()
    assert len(rows) == 9 and rows[0]["count"] >= rows[-1]["count"]


# Full-size fits take minutes: pytest -m "not slow" leaves them out.
FULL_SIZE = {"importance_sums", "score_rows", "reloaded_models"}


# Open: on the 160 rows of the smallest table Spark's line search gives up before the
# gradient is below the tolerance; on sf0.01 the certificate is met.
OPEN = {"lr_stationarity": pytest.mark.xfail(reason="the fit ends early on the smallest table")}


def _names():
    slow = lambda name: [pytest.mark.slow] if name in FULL_SIZE else [OPEN[name]] if name in OPEN else []
    return [pytest.param(name, marks=slow(name)) for name in sorted(spec.oracle_sql())]


@pytest.mark.parametrize("name", _names())
def test_query(spark, db, name):
    ours = spec.queries()[name](spark, SMALL).toPandas()
    assert not differences(ours, db.sql(spec.oracle_sql()[name]).df())
