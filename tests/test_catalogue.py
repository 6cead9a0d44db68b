"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.operators import corpus
from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert [list(map(str, r)) for r in mine] == [list(map(str, r)) for r in theirs] or mine == theirs


def test_each_of_the_21_checks_fails_somewhere(spark):
    failed = {x for r in catalogue.QUERIES["sheet_quality"](spark, SF).collect() for x in r["failed_checks"].split("|")}
    assert failed == set(corpus.document_checks())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
