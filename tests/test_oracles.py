"""Every registered query with an oracle matches DuckDB on the smallest tables.

This is the driver's correctness gate run at sf0.001 (the driver runs it at
sf0.01); queries without an oracle are checked by invariants elsewhere.
"""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from verify import close, rows_of  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck(small_dir):
    import duckdb
    from segment_lab.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, small_dir, duck, name):
    df = E.queries()[name](spark, small_dir)
    got = rows_of(df.columns, df.collect())
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty(), "a query left cached data behind"
    cur = duck.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows_of(cols, cur.fetchall())
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not close(a, b)]
    assert not bad, bad[:3]


def test_each_condition_occurs_on_both_sides(spark, small_dir):
    """Filters, outer joins and NULL rules are exercised by the given tables."""
    q = E.queries()
    table = lambda n: spark.read.parquet(f"{small_dir}/{n}.parquet")
    assert 0 < q["drop_nulls"](spark, small_dir).count() < table("customer").count()
    quadrants = {r["quadrant"]: r["n"] for r in q["quadrant_counts"](spark, small_dir).collect()}
    assert sum(quadrants[k] for k in ("Q1", "Q2", "Q3", "Q4")) < quadrants["Total"]
    phases = q["phase_lookup"](spark, small_dir)
    assert 0 < phases.where("phase is null").count() < phases.count()
    shared = q["shared_items"](spark, small_dir).count()
    bought = table("lineitem").where("l_returnflag = 'R' and l_quantity >= 40").select("l_partkey").distinct().count()
    assert 0 < shared < bought
    assert q["downmix"](spark, small_dir).count() < table("events").count()
    slots = q["one_hot"](spark, small_dir)
    assert 0 < slots.where("slot is null").count() < slots.count()
    f = {r["feature"]: r["F"] for r in q["anova_features"](spark, small_dir).collect()}
    assert f["words_per_digit"] is None and f["chars"] is not None
