"""Registered queries: one function (spark, sf_dir) -> DataFrame per operator key.

Each reads the driver tables under ``sf_dir`` (whole tables; no id subsets)
through the fixture views and applies the library operators.  Doubles are
rounded to 6 places at the very end so that the oracle comparison is stable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels, recode
from ..functions.stats import Z975, r2_from_d
from ..operators import cohort as co
from ..operators import describe as ds
from ..operators import impute as im
from ..operators import linkage as lk
from ..operators import metrics as mt
from ..operators import normal as nm
from ..operators import quantiles as qt
from ..operators import sampling as sp
from ..operators import score as sc
from ..operators.common import per_group
from ..operators.concordance import concordance
from ..operators.cox import d_statistic
from ..operators.rank import scalable_ntile
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources import tables as tb
from . import study

BY = ["sex", "period"]
P1 = fx.PERIODS[0]
P2 = fx.PERIODS[1]
CONTINUOUS = ["age", "t", "bmi"]
NOT_DESCRIBED = ["person_id", "household_id", "linked", "n_rec", "death_date", "bmi_cat", "death_covid"]
SEVERITY = {"A": 1, "N": 2, "R": 3}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle comparison happens on rounded values)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if isinstance(f.dataType, T.DoubleType)
                       else F.col(c) for c, f in zip(df.columns, df.schema.fields)])


def _t(spark, sf_dir) -> fx.Tables:
    return study.tables(spark, sf_dir)


def _cohort(spark, sf_dir) -> DataFrame:
    return fx.cohort(_t(spark, sf_dir))


def _scored(spark, sf_dir) -> DataFrame:
    return study.scored(_t(spark, sf_dir))


def _eth_code() -> F.Column:
    """A string-coded census field for the recode queries ('1'..'18', junk 'X')."""
    pid = F.col("person_id")
    return F.when(pid % 19 == 0, F.lit("X")).otherwise((pid % 19).cast("string"))


def _bmi_clean(spark, sf_dir) -> DataFrame:
    c = _cohort(spark, sf_dir)
    return c.withColumn("bmi", recode.sentinel_to_null(F.col("bmi"), 0))


# --------------------------------------------------------------- sources/sinks
def q_scan_cohort(spark, sf_dir):
    return rounded(_cohort(spark, sf_dir))


def q_csv_roundtrip(spark, sf_dir):
    df = _cohort(spark, sf_dir).select("person_id", "sex", "age", "region", "bmi")
    path = tb.write_csv(df, scratch_path(spark, "csv"), sep="|")
    return rounded(tb.read_csv(spark, path, df.schema, sep="|"))


def q_csv_row_number(spark, sf_dir):
    # one row in seven has no order key; all of them are numbered and written
    df = _cohort(spark, sf_dir).select("person_id", "bmi")
    path = tb.write_csv(df, scratch_path(spark, "csv"), row_number_col="row", order_by=["bmi", "person_id"])
    return rounded(tb.read_csv(spark, path, T.StructType([*df.schema.fields, T.StructField("row", T.LongType())])))


def q_table_roundtrip(spark, sf_dir):
    df = study.linked(_t(spark, sf_dir)).select("person_id", "death_covid", "t", "death_date")
    return tb.save_table(df, f"rw_linked_{uuid.uuid4().hex[:8]}")


def q_table_published(spark, sf_dir):
    df = study.linked(_t(spark, sf_dir)).select("person_id", "death_covid", "t")
    name, path = f"rw_published_{uuid.uuid4().hex[:8]}", scratch_path(spark, "published")
    tb.publish(df.where("death_covid = 1"), name, path, keep=1)
    return tb.publish(df, name, path, keep=1)


def q_csv_quarantine(spark, sf_dir):
    # one line in thirteen has an age that is no number, one in seventeen a field too many
    pid = F.col("person_id")
    age = F.when(pid % 13 == 0, F.lit("n/a")).otherwise(F.col("age").cast("string"))
    more = F.when(pid % 17 == 0, F.lit("more"))
    lines = _cohort(spark, sf_dir).select(F.concat_ws("|", pid, age, "region", more).alias("value"))
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    schema = T.StructType([T.StructField("person_id", T.LongType()), T.StructField("age", T.IntegerType()),
                           T.StructField("region", T.StringType())])
    good, bad = tb.read_csv_quarantine(spark, path, schema, sep="|", header=False)
    return good.withColumn("bad_line", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def q_headings(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    text = tb.columns_except(c, "^bmi", kind="string")
    out = ds.frequency_table(c, text).select("variable", "value", "n")
    return tb.with_headings(out, {"variable": "Variable", "value": "Level", "n": "Count (n)"})


def q_select_by_pattern(spark, sf_dir):
    return tb.select_by_pattern(_cohort(spark, sf_dir), r"^flag_|^n_rec$", keep=["person_id"])


def q_shape(spark, sf_dir):
    return tb.shape(_cohort(spark, sf_dir))


def q_preview(spark, sf_dir):
    return rounded(tb.preview(_cohort(spark, sf_dir), "person_id", 10))


# ----------------------------------------------------------------- projections
def q_project(spark, sf_dir):
    return _cohort(spark, sf_dir).select("person_id", "sex", "age", "region")


def q_rename_project(spark, sf_dir):
    return co.project_rename(_cohort(spark, sf_dir), {
        "census_person_id": "person_id", "household": "household_id",
        "ethnicity_9": "grp", "town_q": "quint", "age": "age"})


def q_drop_cols(spark, sf_dir):
    return co.drop_existing(_cohort(spark, sf_dir), "bmi", "bmi_cat", "household_id", "not_a_column")


def q_derive_sequential(spark, sf_dir):
    return study.linked_causes(_t(spark, sf_dir)).select(
        "person_id", "death_date", "outcome", "death_covid", "death_other", "t")


def q_override_constants(spark, sf_dir):
    return co.override(_cohort(spark, sf_dir), {"flag_b": 0, "supplier_x": 0}).select(
        "person_id", "flag_a", "flag_b", "supplier_x")


def q_baseline_profile(spark, sf_dir):
    df = study.linked(_t(spark, sf_dir))
    profile = co.reference_profile(df, study.PROFILE_KEEPS, study.PROFILE_REFERENCE)
    return rounded(co.override(df, profile).select(
        "person_id", "age", "death_covid", "n_rec", "flag_a", "flag_b", "bmi"))


# --------------------------------------------------------------------- filters
def q_eligible_cohort(spark, sf_dir):
    return co.eligible(_cohort(spark, sf_dir), fx.STUDY_START, exclude_regions=["AFRICA"]).select(
        "person_id", "age", "region", "death_date")


def q_deaths_in_period(spark, sf_dir):
    return co.in_period(_cohort(spark, sf_dir), "death_date", P1[1], P1[2]).select("person_id", "death_date")


def q_risk_set_entry(spark, sf_dir):
    return co.at_risk(_cohort(spark, sf_dir), "death_date", P2[1]).select("person_id", "death_date")


def q_subset_eq(spark, sf_dir):
    return co.subset_eq(_cohort(spark, sf_dir), linked=1, supplier_x=1).select("person_id", "sex", "age")


def q_null_split(spark, sf_dir):
    nulls, known = co.split_null(_cohort(spark, sf_dir), "bmi")
    return (nulls.agg(F.count(F.lit(1)).alias("n")).withColumn("bmi_missing", F.lit(1))
            .unionByName(known.agg(F.count(F.lit(1)).alias("n")).withColumn("bmi_missing", F.lit(0))))


# -------------------------------------------------------------------- recodes
def q_recode_group(spark, sf_dir):
    c = _cohort(spark, sf_dir).withColumn("eth_code", _eth_code())
    return c.select("person_id", "eth_code",
                    recode.ethnicity_9(recode.safe_num("eth_code", "int")).alias("ethnicity_9"))


def q_recode_code(spark, sf_dir):
    c = _cohort(spark, sf_dir).withColumn("eth_code", _eth_code())
    return c.select("person_id", recode.ethnicity_16(recode.safe_num("eth_code", "int")).alias("ethnicity"))


def q_bmi_band(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    return c.select("person_id", recode.bmi_band(F.col("bmi"), F.col("bmi_cat")).alias("bmi_category"))


def q_age_band(spark, sf_dir):
    return _cohort(spark, sf_dir).select("person_id", recode.age_band(F.col("age")).alias("age_band"))


def q_age_interval(spark, sf_dir):
    return _cohort(spark, sf_dir).select("person_id", recode.age_interval(F.col("age")).alias("age_group"))


def q_clean_interval(spark, sf_dir):
    c = _cohort(spark, sf_dir).select("person_id", recode.age_interval(F.col("age")).alias("age_group"))
    return c.withColumn("age_gr", recode.clean_interval(F.col("age_group")))


def q_flags(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    return c.select("person_id",
                    recode.flag(F.col("n_rec") >= 5, three_valued=True).alias("many_records"),
                    recode.flag(F.col("bmi_cat") == "OBESE").alias("obese_label"))


def q_collapse(spark, sf_dir):
    return _cohort(spark, sf_dir).select("person_id", recode.collapse(F.col("n_rec"), 1, 2).alias("n_rec"))


def q_fill_zero(spark, sf_dir):
    return _cohort(spark, sf_dir).fillna(0, subset=["flag_a", "flag_b", "n_rec"]).select(
        "person_id", "flag_a", "flag_b", "n_rec")


def q_sentinel_null(spark, sf_dir):
    return rounded(_bmi_clean(spark, sf_dir).select("person_id", "bmi"))


def q_safe_cast(spark, sf_dir):
    c = _cohort(spark, sf_dir).withColumn("eth_code", _eth_code())
    return c.select("person_id", recode.safe_num(F.substring("grp", 1, 1), "int").alias("grp_num"),
                    recode.safe_num("eth_code", "int").alias("eth_num"))


def q_followup_days(spark, sf_dir):
    return study.linked_causes(_t(spark, sf_dir)).select("person_id", "t")


def q_truncate_outcome(spark, sf_dir):
    two_states = co.truncate_outcome(F.col("death_date"), fx.STUDY_END)
    return study.linked_causes(_t(spark, sf_dir)).select(
        "person_id", two_states.alias("died"), "outcome", "death_covid", "death_other")


def q_recensor_periods(spark, sf_dir):
    return study.periods(_t(spark, sf_dir)).select("person_id", "period", "death_covid", "t")


def q_one_hot(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    cols = {}
    for col, levels in fx.LEVELS.items():
        cols.update(recode.dummies(col, levels))
    return c.select("person_id", *[v.alias(k) for k, v in cols.items()])


def q_poly_terms(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    return rounded(c.select("person_id", *[v.alias(k) for k, v in recode.poly_terms("age", 3).items()]))


# -------------------------------------------------------------------- labels
def q_n_pct_label(spark, sf_dir):
    c = _cohort(spark, sf_dir).where(F.col("linked") == 1)
    return rounded(ds.frequency_table(c, ["region"]))


def q_ci_label(spark, sf_dir):
    s = _scored(spark, sf_dir)
    g = s.groupBy(*BY).agg(F.avg("score").alias("est"),
                           (F.stddev_samp("score") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    lo, hi = F.col("est") - Z975 * F.col("se"), F.col("est") + Z975 * F.col("se")
    return rounded(g.select(*BY, "est", lo.alias("lci"), hi.alias("uci"),
                            labels.est_ci(F.col("est"), lo, hi).alias("est_ci")))


# -------------------------------------------------------------------- linkage
def q_enrich_spine(spark, sf_dir):
    t = _t(spark, sf_dir)
    o = t.orders.select(F.col("o_orderkey").alias("person_id"), "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    x = o.join(c, "o_custkey", "left")
    x = lk.attach_reference(x, n, "c_nationkey")
    x = lk.attach_reference(x, r, "n_regionkey")
    return x.select("person_id", "c_mktsegment", "n_name", "r_name")


def _sources(t: fx.Tables):
    s1 = fx.clinical_records(t.lineitem).select("person_id", "flag_a", "flag_b", "n_rec")
    src2 = fx.second_source(t.lineitem)
    s2 = lk.dedupe_max(src2.select("person_id", "flag_a2", "flag_c"), "person_id")
    s3 = lk.dedupe_severity(src2, "person_id", "severity_code", SEVERITY, "chemocat", ["n_line"])
    return s1, s2, s3


def q_link_sources(spark, sf_dir):
    t = _t(spark, sf_dir)
    s1, s2, s3 = _sources(t)
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    return lk.link_all(spine, [(s1, ["flag_a", "flag_b", "n_rec"]), (s2, ["flag_a2", "flag_c"]),
                               (s3, ["chemocat", "n_line"])], "person_id")


BUCKETS = 16


def bucketed_sources(spark, sf_dir, buckets: int = BUCKETS):
    """The spine and the three sources of the study as tables in equal buckets of person_id."""
    t = _t(spark, sf_dir)
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    tag = uuid.uuid4().hex[:8]
    return [tb.save_bucketed(df, f"rw_bucketed_{k}_{tag}", "person_id", buckets)
            for k, df in enumerate([spine, *_sources(t)])]


def q_link_bucketed(spark, sf_dir):
    spine, s1, s2, s3 = bucketed_sources(spark, sf_dir)
    return lk.link_all(spine, [(s1, ["flag_a", "flag_b", "n_rec"]), (s2, ["flag_a2", "flag_c"]),
                               (s3, ["chemocat", "n_line"])], "person_id")


def q_translate_id(spark, sf_dir):
    t = _t(spark, sf_dir)
    src = fx.second_source(t.lineitem).select("person_id", "flag_a2", "flag_c")
    lookup = t.orders.select("o_orderkey", F.col("o_custkey").alias("household_id"))
    tr = lk.translate_id(src, lookup, "person_id", "o_orderkey", "household_id")
    return lk.dedupe_max(tr, "household_id")


def q_area_index(spark, sf_dir):
    t = _t(spark, sf_dir)
    o = t.orders.select(F.col("o_orderkey").alias("person_id"), "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area_code"))
    x = lk.attach_reference(o.join(c, "o_custkey", "left"), fx.area_index(t), "area_code")
    return rounded(x.select("person_id", "area_name", "town", "town_q"))


def q_link_keep_null(spark, sf_dir):
    t = _t(spark, sf_dir)
    bmi, cat = fx.bmi_expr()
    src = t.orders.select(F.col("o_orderkey").alias("person_id"), bmi.alias("bmi"), cat.alias("bmi_cat")) \
        .where(F.col("bmi").isNotNull())
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    return rounded(lk.link(spine, src, "person_id"))


def q_natural_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    outcome = study.linked(t).select("person_id", "sex", "death_covid")
    return lk.natural_join(fx.cohort(t).select("person_id", "sex", "age"), outcome)


def q_join_suffix(spark, sf_dir):
    c = _cohort(spark, sf_dir).select("person_id", "age", "bmi")
    return rounded(lk.join_suffix(c, co.override(c, {"age": 50, "bmi": 25.0}), "person_id"))


def q_link_flag(spark, sf_dir):
    t = _t(spark, sf_dir)
    lookup = t.lineitem.select(F.col("l_orderkey").alias("person_id"),
                               F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("partner"))
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    return lk.link_flag(spine, lookup, "person_id", "partner", "linked_a")


def q_combine_sources(spark, sf_dir):
    t = _t(spark, sf_dir)
    s1, s2, _ = _sources(t)
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    x = spine.join(s1, "person_id", "left").join(s2, "person_id", "left")
    return lk.combine_sources(x, {"flag_any": ("flag_a", "flag_a2")}).select("person_id", "flag_any")


def q_fanout_observed(spark, sf_dir):
    t = _t(spark, sf_dir)
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    raw = t.lineitem.select(F.col("l_orderkey").alias("person_id"), "l_linenumber")
    one = raw.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_rec"))
    rows = []
    for kind, source in (("collapsed", one), ("raw", raw)):
        _, n = lk.linked_and_counted(spine, lambda s, x=source: s.join(x, "person_id", "left"), allow_fanout=True)
        rows.append((kind, n["n_spine"], n["n_linked"], int(n["n_spine"] != n["n_linked"])))
    return spark.createDataFrame(rows, "source string, n_spine long, n_linked long, fanout int")


def q_fanout_audit(spark, sf_dir):
    t = _t(spark, sf_dir)
    spine = t.orders.select(F.col("o_orderkey").alias("person_id"))
    raw = t.lineitem.select(F.col("l_orderkey").alias("person_id"), "l_linenumber")
    return lk.fanout_audit(spine, spine.join(raw, "person_id", "left"), "person_id")


def q_dedupe_max(spark, sf_dir):
    src = fx.second_source(_t(spark, sf_dir).lineitem)
    return lk.dedupe_max(src.select("person_id", "flag_a2", "flag_c", "n_line"), "person_id")


def q_dedupe_severity(spark, sf_dir):
    src = fx.second_source(_t(spark, sf_dir).lineitem)
    return lk.dedupe_severity(src, "person_id", "severity_code", SEVERITY, "chemocat", ["n_line"])


# ---------------------------------------------------------------- aggregation
def q_sum_all(spark, sf_dir):
    df = study.linked(_t(spark, sf_dir)).where(F.col("linked") == 1)
    return ds.sum_all(df, ["flag_a", "flag_b", "n_rec", "supplier_x", "death_covid"])


def q_null_profile(spark, sf_dir):
    return ds.null_profile(_cohort(spark, sf_dir))


def _describe_frame(spark, sf_dir) -> DataFrame:
    df = study.linked(_t(spark, sf_dir)).where(F.col("linked") == 1)
    return df.withColumns({"bmi_category": recode.bmi_band(F.col("bmi"), F.col("bmi_cat")),
                           "age_band": recode.age_band(F.col("age"))})


def q_describe_all(spark, sf_dir):
    df = _describe_frame(spark, sf_dir)
    dd = F.col("death_date")
    pops = {"all": F.lit(True),
            "p1": dd.between(F.lit(P1[1]), F.lit(P1[2])) & (F.col("death_covid") == 1),
            "p2": dd.between(F.lit(P2[1]), F.lit(P2[2])) & (F.col("death_covid") == 1)}
    return rounded(ds.describe_all(df, *ds.discover(df, NOT_DESCRIBED, CONTINUOUS), pops))


def q_describe_cat(spark, sf_dir):
    df = _describe_frame(spark, sf_dir)
    return rounded(ds.frequency_table(df, ["sex", "grp", "quint", "region", "bmi_cat"]))


def q_describe_num(spark, sf_dir):
    return rounded(ds.numeric_table(_describe_frame(spark, sf_dir), CONTINUOUS))


def q_group_mean(spark, sf_dir):
    return rounded(im.group_means(_bmi_clean(spark, sf_dir), "bmi", ["bmi_cat", "sex"]))


def q_impute_group_mean(spark, sf_dir):
    x = _bmi_clean(spark, sf_dir)
    return rounded(im.impute_group_mean(x, "bmi", "bmi_cat", ["bmi_cat", "sex"]).select("person_id", "bmi"))


def q_split_union(spark, sf_dir):
    x = _bmi_clean(spark, sf_dir).select("person_id", "sex", "bmi")
    means = im.group_means(x, "bmi", ["sex"], "mean_bmi")
    filled = lk.attach_reference(x, per_group(means), "sex")
    return rounded(filled.select("person_id", "sex", F.coalesce("bmi", "mean_bmi").alias("bmi"),
                                 F.col("bmi").isNull().cast("int").alias("imputed")))


def q_coalesce_pred(spark, sf_dir):
    x = _bmi_clean(spark, sf_dir).select("person_id", "sex", "bmi")
    x = lk.attach_reference(x, per_group(im.group_means(x, "bmi", ["sex"], "m")), "sex")
    male, female = (F.when(F.col("sex") == s, F.col("m")) for s in (1, 0))
    return rounded(x.select("person_id", F.coalesce(male, female).alias("prediction_lm")))


def q_imputer_mse(spark, sf_dir):
    return rounded(im.imputer_mse(_bmi_clean(spark, sf_dir), "person_id", "bmi", "bmi_cat", "sex", ["age"]))


def q_imputer_mse_full(spark, sf_dir):
    x = _model_frame(spark, sf_dir).withColumn("bmi", recode.sentinel_to_null(F.col("bmi"), 0))
    return rounded(im.imputer_mse(x, "person_id", "bmi", "bmi_cat", "sex", OLS_FEATURES, "age"))


def q_ols_fit(spark, sf_dir):
    x = _bmi_clean(spark, sf_dir).where(F.col("bmi").isNotNull())
    return rounded(im.ols_coefficients(x, "bmi", "age", "sex"))


def q_ols_summary(spark, sf_dir):
    x = _model_frame(spark, sf_dir).withColumn("bmi", recode.sentinel_to_null(F.col("bmi"), 0))
    return rounded(nm.summary(x, "bmi", ["age", "flag_a", "flag_b", "n_rec", "supplier_x", "grp"], ["sex"], "age"))


def q_impute_audit(spark, sf_dir):
    out = im.impute_two_stage(_cohort(spark, sf_dir), features=["age"])
    return rounded(im.impute_audit(out, "bmi", "sex", "imputed"))


OLS_FEATURES = ["age", "age2", "age3", "flag_a", "flag_b", "n_rec", "supplier_x", "grp", "quint"]


def _model_frame(spark, sf_dir):
    return im.model_frame(_cohort(spark, sf_dir), fill_zero=["flag_a", "flag_b", "n_rec"])


def q_ols_impute(spark, sf_dir):
    x = _model_frame(spark, sf_dir)
    x = materialize(x.withColumn("bmi", recode.sentinel_to_null(F.col("bmi"), 0)))
    out = im.impute_by_model(x, "bmi", "sex", OLS_FEATURES, "age", flag="imputed")
    return rounded(out.where(F.col("imputed") == 2).select("person_id", "sex", "bmi"))


def q_impute_two_stage(spark, sf_dir):
    x = _model_frame(spark, sf_dir)
    out = im.impute_two_stage(x, features=OLS_FEATURES, interact="age")
    return rounded(out.select("person_id", "sex", "bmi", "bmi_cat", "imputed"))


# ------------------------------------------------------------------- sampling
def q_hash_split(spark, sf_dir):
    return sp.hash_split(_cohort(spark, sf_dir).select("person_id"), "person_id", 0.7, "split")


def q_case_sample(spark, sf_dir):
    s = study.scored(_t(spark, sf_dir))
    return rounded(sp.case_sample(s, "person_id", "death_covid", 0.5, "123").select(
        "person_id", "sex", "period", "death_covid", "weight"))


# --------------------------------------------------------------------- scores
def q_risk_score(spark, sf_dir):
    return rounded(study.scored(_t(spark, sf_dir)).select("person_id", "period", "a", "score"))


def _rel(spark, sf_dir) -> DataFrame:
    return sc.relative_risk(study.scored(_t(spark, sf_dir)), {"n_rec": 0, "flag_a": 0}, digits=study.SCORE_DIGITS)


def q_relative_risk(spark, sf_dir):
    return rounded(_rel(spark, sf_dir).select("person_id", "period", "score", "baseline_score",
                                              "relative_risk"))


# ------------------------------------------------------------ quantile tables
def q_ntile20(spark, sf_dir):
    return scalable_ntile(_scored(spark, sf_dir), BY, "score", "person_id", 20).select(
        "person_id", "sex", "period", "q")


def q_ntile100(spark, sf_dir):
    return scalable_ntile(_scored(spark, sf_dir), BY, "score", "person_id", 100).select(
        "person_id", "sex", "period", "q")


def q_threshold_table(spark, sf_dir):
    return rounded(qt.threshold_table(_scored(spark, sf_dir), BY, 20))


def q_capture_curve(spark, sf_dir):
    g = qt.quantile_groups(_scored(spark, sf_dir), BY, 20)
    return rounded(qt.capture(g, BY).select(*BY, "q", "deaths", "cum_deaths", "cum_deaths_p"))


def q_top_centiles(spark, sf_dir):
    return rounded(qt.top_centiles(_scored(spark, sf_dir), BY, 100, 75))


def q_calibration_table(spark, sf_dir):
    return rounded(qt.calibration(_scored(spark, sf_dir), BY, 20))


def q_calibration_long(spark, sf_dir):
    return rounded(qt.calibration_long(_scored(spark, sf_dir), BY, 20))


def q_top_centiles_rel(spark, sf_dir):
    rel = _rel(spark, sf_dir)
    return rounded(qt.top_centiles(rel, BY, 100, 75, score="relative_risk"))


def q_calibration_rel(spark, sf_dir):
    rel = _rel(spark, sf_dir)
    return rounded(qt.calibration_long(rel, BY, 20, score="relative_risk"))


def q_capture_at_k(spark, sf_dir):
    top = qt.top_centiles(_scored(spark, sf_dir), BY, 100, 75)
    flipped = qt.flip_top(top, 100, {0: "Women", 1: "Men"}).where(F.col("q") == 5)
    return rounded(flipped.select(*BY, "q", "sex_label", "deaths", "cum_deaths",
                                  (F.col("cum_deaths_p") * 100).alias("cum_deaths_pct")))


# -------------------------------------------------------------------- metrics
def q_strata_values(spark, sf_dir):
    return mt.explode_strata(study.scored(_t(spark, sf_dir))).select("x", "var").distinct()


def q_union_tagged(spark, sf_dir):
    s = study.scored(_t(spark, sf_dir))
    name = F.concat(F.when(F.col("sex") == 1, "Males").otherwise("Females"), F.lit(", P"),
                    F.col("period").cast("string"))
    return s.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"),
                              F.sum("death_covid").cast("long").alias("events")).withColumn("x", name)


def q_concordance(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("r", F.lit(100.0) - F.col("score"))
    c = concordance(s, BY, "t", "death_covid", "r", variance=False)
    return rounded(c.select(*BY, "n", "events", "con", "dis", "tied", "conc"))


def q_brier(spark, sf_dir):
    return rounded(mt.brier(study.scored(_t(spark, sf_dir)), BY))


D_ROW = ["d_stat", "d_lci", "d_uci", "rsq", "rsq_lci", "rsq_uci"]


def q_metrics_by_strata(spark, sf_dir):
    m = mt.metrics_table(_scored(spark, sf_dir), BY, with_d=True)
    return rounded(m.select(*BY, "x", "var", "n", "events", "con", "dis", "tied", "conc",
                            "conc_lci", "conc_uci", *D_ROW, "brier"))


def q_metrics_subset(spark, sf_dir):
    s = _scored(spark, sf_dir).where(F.col("supplier_x") == 1)
    m = mt.metrics_table(s, BY, strata=None, with_d=True)
    return rounded(m.select(*BY, "x", "var", "n", "events", "conc", "conc_lci", "conc_uci", *D_ROW, "brier"))


def q_metrics_summary(spark, sf_dir):
    m = mt.with_labels(mt.metrics_table(_scored(spark, sf_dir), BY, strata=None, with_d=True))
    name = F.concat(F.when(F.col("sex") == 1, "Males").otherwise("Females"), F.lit(", P"),
                    F.col("period").cast("string"))
    return rounded(m.select(*BY, name.alias("x"), "conc", "conc_lci", "conc_uci", *D_ROW, "brier",
                            "conc_ci", "d_ci", "rsq_ci"))


def q_plot_cstat_age(spark, sf_dir):
    m = mt.metrics_table(_scored(spark, sf_dir), BY, strata=[("age", "age_group")], )
    m = m.where(F.col("x") == "age")
    return rounded(m.select(*BY, "var", recode.clean_interval(F.col("var")).alias("age_gr"),
                            "conc", "conc_lci", "conc_uci"))


def q_d_statistic(spark, sf_dir):
    d = d_statistic(_scored(spark, sf_dir), BY)
    return rounded(d.select(*BY, "d_stat", "d_se", (F.col("d_stat") - Z975 * F.col("d_se")).alias("d_lci"),
                            (F.col("d_stat") + Z975 * F.col("d_se")).alias("d_uci")))


def q_r2_d(spark, sf_dir):
    d = d_statistic(_scored(spark, sf_dir), BY)
    lo, hi = F.col("d_stat") - Z975 * F.col("d_se"), F.col("d_stat") + Z975 * F.col("d_se")
    return rounded(d.select(*BY, r2_from_d(F.col("d_stat")).alias("rsq"), r2_from_d(lo).alias("rsq_lci"),
                            r2_from_d(hi).alias("rsq_uci"), (lo < 0).cast("int").alias("lci_folded")))


def q_metrics_row(spark, sf_dir):
    m = mt.with_labels(mt.metrics_table(_scored(spark, sf_dir), BY, strata=None, with_d=True))
    return rounded(m.select(*BY, "conc", "conc_lci", "conc_uci", "d_stat", "d_lci", "d_uci", "rsq",
                            "rsq_lci", "rsq_uci", "brier", "conc_ci", "d_ci", "rsq_ci"))


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)}
