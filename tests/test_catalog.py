"""Every registered query with an oracle matches DuckDB on sf0.001 (the
driver runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF001
from trendlens.plans.oracles import ORACLES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = se.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = con.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = sorted(tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall())
    assert srows == drows


def test_every_oracle_has_a_query():
    assert set(se.oracle_sql()) <= set(se.queries())


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 * 11 and {"target", "term", "coef", "std_err", "p"} <= set(df.columns)


def test_frame_l_once_is_joined_once_with_the_same_rows(spark):
    from trendlens.plans import frames as fr

    once, again = fr.frame_l_once(spark, SF001), fr.frame_l(spark, SF001)
    assert once.columns == again.columns and once.exceptAll(again).count() == again.exceptAll(once).count() == 0
    assert "Join" not in once._jdf.queryExecution().executedPlan().toString()
    assert fr.frame_l_once(spark, SF001, ["net"]).columns == ["net"]


@pytest.mark.parametrize("spoilt", ["l_extendedprice", "net"])
def test_ols_full_coefs_checks_the_fit_of_both_targets(spark, monkeypatch, spoilt):
    from trendlens.operators import linear

    true = linear.predict

    def off_by_one(df, coefficients, features, target, out="prediction", by=()):
        got = true(df, coefficients, features, target, out, by)
        return got.withColumn(out, got[out] + (1.0 if target == spoilt else 0.0))

    monkeypatch.setattr(linear, "predict", off_by_one)
    rows = {r.term: r.orthogonal for r in se.queries()["ols_full_coefs"](spark, SF001).collect()}
    assert len(rows) == 11 and not rows["Intercept"]
