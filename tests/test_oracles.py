"""Every query with SQL gives the rows of its SQL; every other one gives rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.helpers import cell

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rel = duck.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in rel.description}
    names, place = sorted(df.columns), {d[0]: i for i, d in enumerate(rel.description)}
    assert names == sorted(kinds)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    ours = sorted((tuple(cell(r[n], 12) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(cell(r[place[n]], 12) for n in names) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, (len(wrong), wrong[:2])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert len(row.consumption_profile.hourly_profile["mean"]) == 24
