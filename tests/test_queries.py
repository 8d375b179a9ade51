"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from braidwork.plans import catalogue, ranges, reports

SQL = catalogue.oracle_sql() | ranges.oracle_sql() | reports.oracle_sql()
QUERIES = catalogue.queries() | ranges.queries() | reports.queries()
DATA = "/root/testdata/sf0.001"
TABLES = "documents events lineitem orders customer conversations benchmark part".split()
SHARED = {"seqs": "seq", "sel": "sel", "rec": "rec", "e": "lcp", "s": "seed"}  # tables that many queries begin with


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for t, key in SHARED.items():
        made.execute(f"create table {t} as {catalogue._TO[key]} select * from {t}")
    return made


def once(sql):
    """The query on the shared tables, so that each is made once only."""
    for key in sorted(SHARED.values(), key=lambda k: -len(catalogue._TO[k])):
        head = catalogue._TO[key]
        if sql.startswith(head):
            rest = sql[len(head) :].lstrip()
            return f"with {rest[1:]}" if rest.startswith(",") else rest
    return sql


def rows(frame):
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(map(str, (tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    want = db.execute(once(SQL[name])).fetchdf()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got.fillna(-1)) == rows(want.fillna(-1))
