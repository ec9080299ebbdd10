"""Quarantine, replacement without a gap, headings, observed counts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import linkage as lk
from riskweave.session import scratch_path
from riskweave.sources import tables as tb

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("age", T.IntegerType()), T.StructField("name", T.StringType())])


def test_broken_lines_are_kept_apart(spark):
    path = scratch_path(spark, "lines")
    lines = ["id,age,name", "1,30,a", "2,x,b", "3,40", "4,50,d,e", "5,,f", "zz,1,g"]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    good, bad = tb.read_csv_quarantine(spark, path, SCHEMA)
    assert sorted(map(tuple, good.collect())) == [(1, 30, "a"), (5, None, "f")]
    assert sorted(r.bad_line for r in bad.collect()) == ["2,x,b", "3,40", "4,50,d,e", "zz,1,g"]
    empty = scratch_path(spark, "lines")
    spark.createDataFrame([("id,age,name",)], "value string").write.text(empty)
    good, bad = tb.read_csv_quarantine(spark, empty, SCHEMA)
    assert good.count() == bad.count() == 0


def test_a_reader_sees_the_old_or_the_new_version(spark):
    path = scratch_path(spark, "published")
    tb.publish(spark.range(3).toDF("v"), "rw_gapless", path)
    old = spark.table("rw_gapless")          # a reader that has begun

    class Stops(Exception):
        pass

    @F.udf("long")
    def fails(v):
        raise Stops()

    with pytest.raises(Exception):           # a replacement that fails changes nothing
        tb.publish(spark.range(5).select(fails("id").alias("v")), "rw_gapless", path)
    assert spark.table("rw_gapless").count() == 3
    tb.publish(spark.range(7).toDF("v"), "rw_gapless", path)
    assert spark.table("rw_gapless").count() == 7
    assert old.count() == 3                  # kept while it is among the newest two
    tb.publish(spark.range(9).toDF("v"), "rw_gapless", path)
    tb.publish(spark.range(9).toDF("v"), "rw_gapless", path)
    assert len(tb._versions(spark, path)) == 2
    with pytest.raises(ValueError):
        tb.publish(spark.range(1), "rw_gapless", path, keep=0)


def test_headings_and_columns_by_exclusion(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, x_code string, name string")
    assert tb.columns_except(df, "^id$", "_code$") == ["name"]
    assert tb.columns_except(df, kind="string") == ["x_code", "name"]
    assert tb.with_headings(df, {"id": "Count (n)", "name": "a.b"}).columns == ["Count (n)", "x_code", "a.b"]
    for bad in ({"none": "x"}, {"id": "name"}):
        with pytest.raises(ValueError):
            tb.with_headings(df, bad)


def test_counts_are_observed_while_rows_are_written(spark):
    spine = spark.range(10).toDF("id")
    one = spark.range(5).select("id", F.lit(1).alias("v"))
    out, n = lk.linked_and_counted(spine, lambda s: s.join(one, "id", "left"))
    assert n == {"n_spine": 10, "n_linked": 10} and out.count() == 10
    twice = one.union(one)
    with pytest.raises(ValueError):
        lk.linked_and_counted(spine, lambda s: s.join(twice, "id", "left"))
    _, n = lk.linked_and_counted(spine, lambda s: s.join(twice, "id", "left"), allow_fanout=True)
    assert n == {"n_spine": 10, "n_linked": 15}


def test_suffixes_that_are_taken(spark):
    a = spark.createDataFrame([(1, 2, 3)], "id int, x int, x_base int")
    b = spark.createDataFrame([(1, 5, 6)], "id int, x int, x_y int")
    out = lk.join_suffix(a, b, "id", ("_base", "_y"))
    assert out.columns == ["id", "x_base_base", "x_base", "x_y_y", "x_y"]
    assert tuple(out.first()) == (1, 2, 3, 5, 6)
