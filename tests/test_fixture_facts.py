"""Facts measured independently on DuckDB (FIXTURES.md) reproduced through the library."""

from pyspark.sql import functions as F

from conftest import SF0001
from riskweave.operators import metrics as mt
from riskweave.plans import study
from riskweave.sources import fixtures as fx


def test_cohort_counts(spark):
    t = study.tables(spark, SF0001)
    c = fx.cohort(t)
    row = c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("ids"),
                F.sum("linked").alias("linked"), F.sum((F.col("sex") == 1).cast("int")).alias("men"),
                F.sum(F.col("bmi").isNull().cast("int")).alias("bmi_null"),
                F.sum((F.col("bmi") == 0).cast("int")).alias("bmi_zero"),
                F.sum(F.col("bmi_cat").isNull().cast("int")).alias("cat_null"),
                F.sum(((F.col("bmi").isNull() | (F.col("bmi") == 0)) & F.col("bmi_cat").isNull())
                      .cast("int")).alias("stage2")).first()
    assert (row.n, row.ids, row.linked, row.men) == (1500, 1500, 1473, 781)
    assert (row.bmi_null, row.bmi_zero, row.cat_null, row.stage2) == (215, 117, 300, 67)


def test_period_one_events(spark):
    p = study.periods(study.tables(spark, SF0001)).where(F.col("period") == 1)
    row = p.agg(F.sum("death_covid").alias("ev"), F.countDistinct("t").alias("dt")).first()
    assert (row.ev, row.dt) == (95, 61)
    by_sex = {r.sex: r.ev for r in p.where(F.col("linked") == 1).groupBy("sex")
              .agg(F.sum("death_covid").alias("ev")).collect()}
    assert by_sex == {0: 43, 1: 52}


def test_concordance_pooled_p1(spark):
    s = study.scored(study.tables(spark, SF0001)).where(F.col("period") == 1)
    r = mt.concordance_ci(s, []).first()
    assert (r.con, r.dis, r.tied) == (83459, 51286, 588)
    assert abs(r.conc - 0.618866) < 5e-7
