import pytest
from pyspark.sql import functions as F

from trendlens.roles import Roles
from trendlens.sources import joins, load


def test_csv_na_spellings_stay_numeric(spark, tmp_path):
    p = tmp_path / "na.csv"
    p.write_text("cat,x,y\na,1.5,NA\nb,nan,2\nnull,3,\nc,N/A,4\n")
    df = load.read_csv(spark, str(p), Roles(["cat"], ["x"], ["y"]))
    assert dict(df.dtypes)["x"] == "double"
    rows = df.orderBy("y").collect()
    assert [r.x for r in df.collect()].count(None) == 2
    assert sum(r.cat is None for r in rows) == 1


def test_required_columns_and_roles(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    with pytest.raises(ValueError, match="missing required columns"):
        load.require_columns(df, ["a", "zz"])
    with pytest.raises(ValueError):
        load.check_roles(df, Roles([], [], ["b"]))
    with pytest.raises(ValueError, match="empty"):
        load.check_roles(df.where("a > 5"), Roles(["a"], [], ["b"]))


def test_first_child_left_join_semantics(spark):
    run = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, asm string")
    bridge = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "lid long, run_id long")
    meas = spark.createDataFrame([(10, False, 1.0), (10, False, 2.0), (10, True, 9.0), (11, False, 5.0)],
                                 "lnps_id long, ignore boolean, d double")
    out = joins.first_child_left_join(run, "id", bridge, "run_id", "lid",
                                      [joins.Measurement(meas, "lnps_id", ["d"], ~F.col("ignore"))],
                                      not_null=["asm"])
    got = sorted((r.id, r.first_child, r.d) for r in out.collect())
    assert got == [(1, 10, 1.0), (1, 10, 2.0), (2, 20, None)]


def test_salted_left_join_is_exact_under_a_hot_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k long, l string")
    right = spark.createDataFrame([(1, float(i)) for i in range(500)] + [(2, 1.0), (2, 2.0)], "rk long, v double")
    out = joins.salted_left_join(left, right, "k", "rk", min_rows=100)
    ref = left.join(right, left.k == right.rk, "left")
    key = lambda r: (r.k if r.k is not None else -1, r.l, r.rk if r.rk is not None else -1, r.v if r.v is not None else -1.0)
    assert sorted(map(key, out.collect())) == sorted(map(key, ref.collect()))
    assert [(r[0], r[1]) for r in joins.hot_keys(right, "rk", min_rows=100).collect()] == [(1, 5)]


def test_salted_left_join_same_key_name(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, l string")
    right = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (3, 9.0)], "k long, v double")
    out = joins.salted_left_join(left, right, "k", "k", min_rows=1)
    got = sorted((r[0], r[1], r[3]) for r in out.collect())
    assert got == [(1, "a", 1.0), (1, "a", 2.0), (1, "a", 3.0), (2, "b", None)]


def test_salted_left_join_keeps_all_rows_beside_a_hot_null_key(spark):
    left = spark.createDataFrame([(i % 9, i) for i in range(50)] + [(None, 99)], "k long, l long")
    right = spark.createDataFrame([(None, float(i)) for i in range(400)] + [(2, 1.0), (2, 2.0), (3, 5.0)],
                                  "rk long, v double")
    ref = left.join(right, left.k == right.rk, "left")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for rows in (1, 100):
        out = joins.salted_left_join(left, right, "k", "rk", min_rows=rows)
        assert sorted(map(key, out.collect())) == sorted(map(key, ref.collect()))


def test_csv_with_doubled_quotes(spark, tmp_path):
    from trendlens.sources.load import read_csv

    f = tmp_path / "a.csv"
    f.write_text('id,name,v\n1,"say ""hi"", twice",2.5\n2, NA ,NA\n')
    rows = read_csv(spark, str(f)).collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi", twice', "2.5"), ("2", " NA ", None)]
    g = tmp_path / "b.csv"
    g.write_text('id,name\n1,"two\nlines"\n')
    assert read_csv(spark, str(g), multi_line=True).first()["name"] == "two\nlines"
