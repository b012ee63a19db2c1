"""Every query with SQL gives what its SQL gives in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tokenweave.options import BuildOptions, SearchOptions
from tokenweave.plans import catalogue, oracle
from tokenweave.plans.fixture import EX_BITS, Fixture

SF = "/root/testdata/sf0.01"
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def agree(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    agree(entry_point.queries()[name](spark, SF), duck.sql(SQL[name]))


class Pruned(Fixture):
    """With so few probes and documents to rescore that each step leaves some out."""

    build = BuildOptions(64, EX_BITS)
    options = SearchOptions(nprobe=2, k_refine=40, k_full_bit=16, cagra_itopk_size=150, num_chunks=3)


@pytest.mark.parametrize("name", sorted(n for n, sql in oracle.ORACLE_SQL.items() if "opt AS" in sql))
def test_pruned_query_matches_sql(spark, duck, name):
    opt = "SELECT 64 AS clusters, 2 AS nprobe, 40 AS k_refine, 16 AS k_full, 3 AS most_chunks"
    agree(catalogue.PLANS[name](Pruned(spark, SF)), duck.sql(oracle.assemble(oracle.FINAL[name], opt=opt)))


def test_entry(spark):
    assert entry_point.entry(spark).count() == 40
