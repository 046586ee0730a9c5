"""Every registered query against its SQL twin on the small test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from backglot.plans import registry
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: query for name, (query, _) in registry.QUERIES.items()}
ORACLES = {name: sql for name, (_, sql) in registry.QUERIES.items() if sql}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER) == ""


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {(r["stage"], r["model"]) for r in rows} == {(1, "memory"), (2, "first"), (2, "second")}
    assert all(r["total_translations"] > 0 and 0 <= r["bleu_score"] < 1 for r in rows)
