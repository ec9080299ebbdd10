"""Operator semantics on hand-made edge rows and imputation/linkage properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from riskweave.functions import labels, recode
from riskweave.operators import cohort as co
from riskweave.operators import describe as ds
from riskweave.operators import impute as im
from riskweave.operators import linkage as lk
from riskweave.operators import quantiles as qt
from riskweave.operators import score as sc
from riskweave.plans import study
from riskweave.sources import fixtures as fx

P = ((1, dt.date(2020, 1, 24), dt.date(2020, 4, 30)), (2, dt.date(2020, 5, 1), dt.date(2020, 7, 28)))


def test_recensor_null_semantics(spark):
    rows = [(1, None, 0), (2, None, 1), (3, dt.date(2020, 4, 30), 1), (4, dt.date(2020, 3, 1), 1),
            (5, dt.date(2020, 6, 1), 1)]
    df = spark.createDataFrame(rows, "pid long, death_date date, death_covid int")
    got = {(r.pid, r.period): (r.death_covid, r.t) for r in co.recensor(df, P).collect()}
    assert got[(1, 1)] == (0, 97)            # alive: NULL AND FALSE -> 0
    assert got[(2, 1)] == (None, 97)         # null date with outcome 1 stays null
    assert got[(3, 1)] == (1, 97)            # boundary day: event (<=) at full time (<)
    assert got[(4, 1)] == (1, 37)
    assert (4, 2) not in got                 # dead before period 2: not at risk
    assert got[(5, 2)] == (1, 31) and got[(5, 1)] == (0, 97)


def test_bmi_band_precedence_and_labels(spark):
    df = spark.createDataFrame([(35.0, "IDEAL"), (None, "UNDER 20 NULLS"), (None, None), (17.0, None),
                                (27.0, "OBESE")], "bmi double, bmi_cat string")
    got = [r.b for r in df.select(recode.bmi_band(F.col("bmi"), F.col("bmi_cat")).alias("b")).collect()]
    assert got == ["18.5 to 25", "Missing", "Missing", "< 18.5", "25 to 30"]


def test_safe_cast_and_dedupe_max(spark):
    df = spark.createDataFrame([(1, "10"), (1, "9"), (2, "x"), (None, "1")], "k long, v string")
    got = {r.k: r.v for r in lk.dedupe_max(df, "k").collect()}
    assert got == {1: 10.0, 2: None}                 # numeric max, junk -> null, null key dropped


def test_labels(spark):
    df = spark.createDataFrame([(12345, 12.345, 0.5, 0.1234, 45.6)], "n long, p double, c double, d double, m double")
    r = df.select(labels.n_pct(F.col("n"), F.col("p")).alias("a"), labels.ci_text(F.col("c")).alias("b"),
                  labels.ci_text(F.col("d")).alias("c"), labels.short_text(F.col("m")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("12,345 (12.35)", "0.50", "0.123", "45.6")


def test_clean_interval(spark):
    df = spark.createDataFrame([("[20,30)",)], "v string")
    assert df.select(recode.clean_interval(F.col("v"))).first()[0] == " 20-30"


def test_relative_risk_baseline_is_one(spark):
    df = spark.createDataFrame([(70, 0, 0), (40, 3, 1)], "age int, n_rec int, flag_a int").withColumn("sex", F.lit(1))
    out = sc.relative_risk(df, {"n_rec": 0, "flag_a": 0}).collect()
    assert out[0].relative_risk == pytest.approx(1.0)
    assert out[1].relative_risk > 0


def test_zero_baseline_score_gives_null_ratio(spark):
    df = spark.createDataFrame([(60, 1, 1.0, 0.0)], "age int, sex int, score double, baseline_score double")
    assert df.select(F.try_divide("score", "baseline_score")).first()[0] is None


def test_capture_curve_ends_at_one(spark):
    s = study.scored(study.tables(spark, SF0001))
    t = qt.threshold_table(s, ["sex", "period"], 20).where(F.col("q") == 1).collect()
    assert all(r.cum_deaths_p == pytest.approx(1.0) for r in t)
    sizes = qt.quantile_groups(s, ["sex", "period"], 20).groupBy("sex", "period").agg(
        (F.max("total") - F.min("total")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)


def test_two_stage_imputation_properties(spark):
    t = study.tables(spark, SF0001)
    c = fx.cohort(t)
    out = im.impute_two_stage(im.model_frame(c, fill_zero=["flag_a", "flag_b", "n_rec"]),
                              features=["age", "age2", "flag_a", "n_rec", "grp"], interact="age")
    assert out.count() == c.count()
    assert out.where(F.col("bmi").isNull()).count() == 0
    joined = out.alias("o").join(c.alias("c"), "person_id").where((F.col("c.bmi") > 0))
    assert joined.where(F.col("o.bmi") != F.col("c.bmi")).count() == 0     # observed rows unchanged
    counts = {r.imputed: r["count"] for r in out.groupBy("imputed").count().collect()}
    assert counts[2] == 67                                                  # FIXTURES: stage-2 rows


def test_linkage_keeps_spine_rows(spark):
    t = study.tables(spark, SF0001)
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    src = fx.clinical_records(t.lineitem)
    linked = lk.link(spine, src, "person_id", ["flag_a"])
    audit = lk.fanout_audit(spine, linked, "person_id").first()
    assert audit.fanout == 0 and audit.n_spine == 1500
    raw = lk.fanout_audit(spine, spine.join(t.lineitem.withColumnRenamed("l_orderkey", "person_id"),
                                            "person_id", "left"), "person_id").first()
    assert raw.fanout == 1 and raw.max_rows_per_key > 1


def test_join_suffix(spark):
    a = spark.createDataFrame([(1, 2.0)], "id long, score double")
    b = spark.createDataFrame([(1, 3.0)], "id long, score double")
    r = lk.join_suffix(a, b, "id", ("_base", "")).first()
    assert (r.score_base, r.score) == (2.0, 3.0)


def test_ols_impute_fills_every_missing_bmi(spark):
    from riskweave.plans import catalog
    out = catalog.q_ols_impute(spark, SF0001)
    assert out.count() == 215 + 117                      # null + zero-sentinel BMI (FIXTURES)
    assert out.where(F.col("bmi").isNull()).count() == 0


def test_competing_deaths(spark):
    rows = [(1, "2020-02-03", "COVID"), (2, "2020-02-03", "Not COVID"), (3, "2020-06-01", "COVID"), (4, None, "Alive"), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, d string, cause string").withColumn("death_date", F.col("d").cast("date"))
    out = co.add_outcome(df, "2020-01-24", "2020-04-30", cause_col="cause").collect()
    got = {r.id: (r.outcome, r.death_covid, r.death_other, r.t) for r in out}
    assert got == {1: ("COVID", 1, 0, 10), 2: ("Not COVID", 0, 1, 10), 3: ("Alive", 0, 0, 97),
                   4: ("Alive", 0, 0, 97), 5: ("Alive", 0, 0, 97)}


def test_natural_join_and_database(spark):
    from riskweave.sources.tables import use_database
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "id int, k string, v int")
    b = spark.createDataFrame([(1, "x", 9.0)], "id int, k string, w double")
    assert sorted(tuple(r) for r in lk.natural_join(a, b).collect()) == [(1, "x", 5, 9.0), (1, "y", 6, None)]
    assert use_database(spark, "default") == "default"


def test_translate_id_with_a_repeated_lookup(spark):
    src = spark.createDataFrame([("a", 1)], "nhs string, v int")
    lookup = spark.createDataFrame([("a", 10), ("a", 10), ("b", 11)], "nhs string, pid int")
    assert lk.translate_id(src, lookup, "nhs", "nhs", "pid").count() == 1


def test_model_imputation_leaves_what_it_cannot_predict(spark):
    rows = [(i, "a", 2.0 * i + 1, i, "x" if i % 2 else "y") for i in range(8)]
    rows += [(8, "a", None, 10, "x"), (9, "a", None, 10, "new"), (10, "a", None, 10, None), (11, "b", None, 3, "x"),
             (12, None, None, 3, "x")]
    df = spark.createDataFrame(rows, "id int, g string, v double, age int, k string")
    got = {r.id: (r.v, r.f) for r in im.impute_by_model(df, "v", "g", ["age", "k"], flag="f").collect()}
    assert len(got) == 13
    assert got[8][0] == pytest.approx(21.0) and got[8][1] == 2
    assert [got[k] for k in (9, 10, 11, 12)] == [(None, None)] * 4
    assert all(got[i] == (2.0 * i + 1, 0) for i in range(8))


def test_full_model_hold_out(spark):
    from riskweave.plans import catalog
    r = catalog.q_imputer_mse_full(spark, SF0001).first()
    assert r.n_test > 0 and 0 < r.mse_lm and 0 < r.mse_mm


def _many(spark):
    """Eighty record columns of several types behind what a profile keeps."""
    base = spark.createDataFrame([(1, 40, 1, "x", dt.date(2020, 2, 1), True, 31.5), (None, None, None, None, None, None, None)],
                                 "pid long, age int, event int, region string, day date, ever boolean, bmi double")
    return base.withColumns({f"c{k}": F.lit(k).cast(("int", "double", "decimal(9,2)", "tinyint")[k % 4]) for k in range(80)})


def test_reference_profile_by_exclusion(spark):
    df = _many(spark)
    profile = co.reference_profile(df, ["pid", "age", "event"], {"bmi": 25, "region": "none"})
    assert set(profile) == {"ever", "bmi", "region", *(f"c{k}" for k in range(80))}
    out = co.override(df, profile)
    assert out.dtypes == df.dtypes
    for r, kept in zip(out.orderBy("pid").collect(), (None, 1)):
        assert r.pid == kept and r.bmi == 25.0 and r.region == "none" and r.ever is False
        assert all(r[f"c{k}"] == 0 for k in range(80))
    assert out.where("pid = 1").first().day == dt.date(2020, 2, 1)
    assert co.override(df.limit(0), co.reference_profile(df.limit(0), [])).count() == 0
    for keep, values in ((["nope"], {}), ([], {"nope": 1}), (["bmi"], {"bmi": 25})):
        with pytest.raises(ValueError):
            co.reference_profile(df, keep, values)


def test_profile_from_table(spark):
    df = _many(spark)
    table = lambda rows: spark.createDataFrame(rows, "column string, value string, note string")
    rows = [(f"c{k}", "0", None) for k in range(80)] + [("bmi", "25.0", "centre"), ("ever", "false", ""), ("day", None, "")]
    out = co.override(df, co.profile_from_table(df, table(rows)))
    assert out.dtypes == df.dtypes
    for r in out.collect():
        assert r.bmi == 25.0 and r.ever is False and r.day is None and all(r[f"c{k}"] == 0 for k in range(80))
    assert co.profile_from_table(df, table([]).limit(0)) == {}
    for wrong in ([("nope", "1", "")], [("bmi", "1", ""), ("bmi", "2", "")], [(None, "1", "")], [("bmi", "wide", "")],
                  [(f"c{k % 80}", "0", "") for k in range(500)]):
        with pytest.raises(ValueError):
            co.profile_from_table(df, table(wrong))


def test_variables_by_exclusion(spark):
    df = _many(spark).select("pid", "age", "event", "region", "ever", "bmi", "c0", "c1", "c2")
    assert ds.discover(df, ["pid", "not there"], ["age"]) == (["event", "region", "ever", "c0"], ["age", "bmi", "c1", "c2"])
    assert ds.discover(df, df.columns) == ([], [])
    with pytest.raises(ValueError):
        ds.discover(df, [], ["not there"])
