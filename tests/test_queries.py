"""Queries of the reference's operators against the same SQL in DuckDB, on the smallest tables."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from pairglass.plans import queries as q  # noqa: E402
from pairglass.plans.queries import QUERIES, SQL  # noqa: E402
from pairglass.sources.store import settle  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module", autouse=True)
def shared_parts():
    """What many queries begin with (rows, counts, networks) is made once for all of them."""
    made, whole = {}, {}

    def once(name, f):
        def run(spark, sf, *args):
            key = (name, sf, *args)
            if key not in made:
                got = f(spark, sf, *args)
                made[key] = settle(got, name) if name in ("rows", "whole_network") else got
            return made[key]

        return run

    for name in ("rows", "counts", "half_counts", "networks", "trees", "votes", "whole_network"):
        whole[name] = getattr(q, name)
        setattr(q, name, once(name, whole[name]))
    yield
    for name, f in whole.items():
        setattr(q, name, f)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(names, got):
    at = [names.index(c) for c in sorted(names)]
    plain = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
