"""Plan checks: no single-partition exchange on person-level data, pushdown reaches the scan."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from riskweave.operators import metrics as mt
from riskweave.operators.rank import scalable_ntile
from riskweave.plans import study
from riskweave.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ntile_has_no_single_partition_window(spark):
    s = study.scored(study.tables(spark, SF0001))
    plan = _plan(scalable_ntile(s, ["sex", "period"], "score", "person_id", 20))
    assert "SinglePartition" not in plan


def test_concordance_has_no_single_partition(spark):
    s = study.scored(study.tables(spark, SF0001))
    plan = _plan(mt.concordance_ci(s, ["sex", "period"]))
    assert "SinglePartition" not in plan


def test_filter_and_columns_pushed_to_scan(spark):
    t = study.tables(spark, SF0001)
    df = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_describe_all_scans_once(spark):
    from riskweave.plans import catalog
    plan = _plan(catalog.q_describe_all(spark, SF0001))
    assert plan.count("lineitem.parquet") == 1


def test_bucketed_linkage_does_not_shuffle(spark):
    from riskweave.operators import linkage as lk
    from riskweave.plans import catalog
    spine, *sources = catalog.bucketed_sources(spark, SF0001, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lk.link_all(spine, [(s, ()) for s in sources], "person_id")
        plan = _plan(out.groupBy("person_id").agg(*[F.sum(c).alias(c) for c in ("n_rec", "flag_c", "n_line")]))
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and plan.count("Bucketed: true") == 4
        assert out.count() == spine.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def no_small_joins(spark):
    """The planner broadcasts nothing by itself, as with tables whose size it misjudges."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _people(spark, n=4000):
    """Two sexes and no sex, labels with gaps, a fifth of the values missing and some 0."""
    i = F.col("id")
    return spark.range(0, n, 1, 6).select(
        i.alias("person_id"), F.when(i % 50 != 0, (i % 2).cast("int")).alias("sex"), (20 + i % 61).cast("int").alias("age"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 11 == 0, 0.0).otherwise(18 + (i % 61) / 4 + (i % 2)).alias("bmi"),
        F.when(i % 3 != 0, F.concat(F.lit("c"), (i % 7).cast("string"))).alias("bmi_cat"))


def test_rows_are_not_dealt_by_group_to_be_imputed(spark, no_small_joins):
    from riskweave.operators import impute as im
    df = _people(spark)
    clean = df.withColumn("bmi", F.when(F.col("bmi") != 0, F.col("bmi")))
    for out in (im.impute_group_mean(clean, "bmi", "bmi_cat", ["bmi_cat", "sex"]),
                im.impute_by_model(clean, "bmi", "sex", ["age"]),
                im.impute_two_stage(df, features=["age"])):
        assert "hashpartitioning" not in _plan(out) and out.count() == df.count()
    mse = _plan(im.imputer_mse(clean, "person_id", "bmi", "bmi_cat", "sex", ["age"]))
    assert "hashpartitioning(bmi_cat" not in mse


def test_rows_are_not_dealt_by_sex_to_meet_its_mean(spark, no_small_joins):
    from riskweave.plans import catalog
    for query in (catalog.q_split_union, catalog.q_coalesce_pred):
        assert "hashpartitioning(sex" not in _plan(query(spark, SF0001))


def test_many_groups_are_joined_by_key(spark, no_small_joins, monkeypatch):
    from riskweave.operators import common
    from riskweave.operators import impute as im
    found = {}
    for most in (common.FEW_GROUPS, 2):
        monkeypatch.setattr(common, "FEW_GROUPS", most)
        out = im.impute_two_stage(_people(spark), features=["age"])
        assert ("hashpartitioning" in _plan(out)) == (most == 2)
        found[most] = sorted((r.person_id, r.sex, round(r.bmi, 9) if r.bmi is not None else None, r.imputed) for r in out.collect())
    assert found[2] == found[1_000] and {r[3] for r in found[2]} == {None, 0, 1, 2}
