"""Registry of oracle SQL strings keyed like ``catalog.QUERIES``.
"""

from __future__ import annotations

from ..operators.sampling import threshold_hex
from . import oracle_ols as ols
from .oracle_cox import d_sql
from .oracle import calibration_long_sql, threshold_sql, tile_groups, with_cohort

R6 = "round({}, 6)"
SPLIT70 = threshold_hex(0.7)
HALF = threshold_hex(0.5)

BC = "bc AS (SELECT * REPLACE (nullif(bmi, 0) AS bmi) FROM cohort)"
ETH = ("eth AS (SELECT *, CASE WHEN person_id % 19 = 0 THEN 'X' ELSE CAST(person_id % 19 AS VARCHAR) END"
       " AS eth_code FROM cohort), eth2 AS (SELECT *, TRY_CAST(eth_code AS INTEGER) AS c FROM eth)")
AGE_BAND = ("CASE WHEN age >= 19 AND age < 30 THEN '19 - 29 years' WHEN age >= 30 AND age < 40 THEN '30 - 39 years' "
            "WHEN age >= 40 AND age < 50 THEN '40 - 49 years' WHEN age >= 50 AND age < 60 THEN '50 - 59 years' "
            "WHEN age >= 60 AND age < 70 THEN '60 - 69 years' WHEN age >= 70 AND age < 80 THEN '70 - 79 years' "
            "WHEN age >= 80 AND age < 90 THEN '80 - 89 years' WHEN age >= 90 THEN '90+ years' END")
BMI_BAND = ("CASE WHEN (bmi >= 18.5 AND bmi < 25) OR bmi_cat = 'IDEAL' THEN '18.5 to 25' "
            "WHEN bmi < 18.5 OR bmi_cat = 'UNDERWEIGHT' THEN '< 18.5' "
            "WHEN (bmi >= 25 AND bmi < 30) OR bmi_cat = 'OVERWEIGHT' THEN '25 to 30' "
            "WHEN bmi >= 30 OR bmi_cat = 'OBESE' THEN '>= 30' "
            "WHEN bmi IS NULL AND (bmi_cat IS NULL OR bmi_cat = 'UNDER 20 NULLS') THEN 'Missing' END")
AGE_INTERVAL = ("CASE WHEN age >= 19 AND age < 30 THEN '[19,30)' WHEN age >= 30 AND age < 40 THEN '[30,40)' "
                "WHEN age >= 40 AND age < 50 THEN '[40,50)' WHEN age >= 50 AND age < 60 THEN '[50,60)' "
                "WHEN age >= 60 AND age < 70 THEN '[60,70)' WHEN age >= 70 AND age < 80 THEN '[70,80)' "
                "WHEN age >= 80 AND age < 90 THEN '[80,90)' WHEN age >= 90 AND age < 101 THEN '[90,101)' END")


def clean(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[()]', '', 'g'), "
            f"'\\]\\]', '', 'g'), ',', '-', 'g'), '\\[', ' ', 'g')")


def n_pct(n: str, pct: str) -> str:
    return f"format('{{:,}}', {n}) || ' (' || printf('%.2f', round({pct}, 2)) || ')'"


def short(x: str) -> str:
    s = f"printf('%.2f', round({x}, 2))"
    return f"regexp_replace(regexp_replace({s}, '(\\.[0-9]*[1-9])0+$', '\\1'), '\\.0+$', '')"


def ci_text(x: str) -> str:
    return f"regexp_replace(printf('%.3f', round({x}, 3)), '(\\.[0-9]{{2}})0$', '\\1')"


def est_ci(e: str, lo: str, hi: str) -> str:
    return f"{ci_text(e)} || ' (' || {ci_text(lo)} || ' to ' || {ci_text(hi)} || ')'"


S2 = ("s2 AS (SELECT l_orderkey AS person_id,"
      " max(TRY_CAST(CASE WHEN l_returnflag = 'A' THEN '1' ELSE '0' END AS DOUBLE)) AS flag_a2,"
      " max(TRY_CAST(CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END AS DOUBLE)) AS flag_c,"
      " max(TRY_CAST(l_linenumber AS DOUBLE)) AS n_line_d"
      " FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)")
S3 = ("s3 AS (SELECT l_orderkey AS person_id,"
      " CAST(max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END) AS INTEGER) AS chemocat,"
      " max(l_linenumber) AS n_line FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)")

DESC = (f"d AS (SELECT *, {BMI_BAND} AS bmi_category, {AGE_BAND} AS age_band FROM linked_t WHERE linked = 1)")
CATEGORICAL = ["sex", "grp", "quint", "region", "flag_a", "flag_b", "supplier_x", "bmi_category", "age_band"]
CONTINUOUS = ["age", "t", "bmi"]


def _long_cat(src: str, cols, pop: bool) -> str:
    p = "population, " if pop else ""
    return " UNION ALL ".join(f"SELECT {p}'{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM {src}" for c in cols)


def _long_num(src: str, cols, pop: bool) -> str:
    p = "population, " if pop else ""
    return " UNION ALL ".join(f"SELECT {p}'{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols)


def freq_sql(src_cte: str, src: str, cols, pop: bool) -> str:
    p = "population, " if pop else ""
    part = "PARTITION BY population, variable" if pop else "PARTITION BY variable"
    return (f"{src_cte}, lc AS ({_long_cat(src, cols, pop)}),"
            f" cnt AS (SELECT {p}variable, value, count(*) AS n FROM lc GROUP BY ALL),"
            f" catf AS (SELECT *, CAST(n AS DOUBLE) * 100 / sum(n) OVER ({part}) AS pct FROM cnt)")


def num_sql(src: str, cols, pop: bool) -> str:
    p = "population, " if pop else ""
    return (f"ln AS ({_long_num(src, cols, pop)}),"
            f" numf AS (SELECT {p}variable, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM ln GROUP BY ALL)")


def metrics_sql(strata, where: str = "TRUE", variance: bool = True) -> str:
    parts = [f"SELECT 'all' AS x, 'all' AS var, * FROM scored WHERE {where}"]
    parts += [f"SELECT '{n}' AS x, CAST({c} AS VARCHAR) AS var, * FROM scored WHERE {where}" for n, c in strata]
    keys = "sex, period, x, var"
    body = f"""
base AS (SELECT sex, period, x, var, person_id, 100 - score AS r, 2 * t + 1 - death_covid AS k, score, death_covid
         FROM ({' UNION ALL '.join(parts)})),
grp AS (SELECT {keys}, count(*) AS n, CAST(sum(death_covid) AS BIGINT) AS events,
               avg(power(score / 100 - death_covid, 2)) AS brier FROM base GROUP BY ALL),
pairs AS (SELECT e.sex, e.period, e.x, e.var, e.person_id AS pi, b.person_id AS pj,
                 CASE WHEN b.r > e.r THEN 1 WHEN b.r < e.r THEN 2 ELSE 3 END AS kind
          FROM base e JOIN base b ON e.sex = b.sex AND e.period = b.period AND e.x = b.x AND e.var = b.var
                                  AND b.k > e.k
          WHERE e.k % 2 = 0),
tot AS (SELECT {keys}, CAST(count(*) FILTER (WHERE kind = 1) AS DOUBLE) AS con,
               CAST(count(*) FILTER (WHERE kind = 2) AS DOUBLE) AS dis,
               CAST(count(*) FILTER (WHERE kind = 3) AS DOUBLE) AS tied FROM pairs GROUP BY ALL),
cc AS (SELECT *, (con + tied / 2) / (con + dis + tied) AS conc, con + dis + tied AS np FROM tot),
per AS (SELECT {keys}, pid, count(*) FILTER (WHERE kind = 1) AS c1, count(*) FILTER (WHERE kind = 2) AS c2,
               count(*) FILTER (WHERE kind = 3) AS c3
        FROM (SELECT {keys}, pi AS pid, kind FROM pairs UNION ALL SELECT {keys}, pj AS pid, kind FROM pairs)
        GROUP BY ALL),
vv AS (SELECT per.sex, per.period, per.x, per.var,
              sum(power((c1 + c3 / 2.0 - cc.conc * (c1 + c2 + c3)) / cc.np, 2)) AS cvar
       FROM per JOIN cc USING (sex, period, x, var) GROUP BY ALL),
m AS (SELECT g.*, coalesce(cc.con, 0) AS con, coalesce(cc.dis, 0) AS dis, coalesce(cc.tied, 0) AS tied, cc.conc,
             cc.conc - 1.96 * sqrt(vv.cvar) AS conc_lci, cc.conc + 1.96 * sqrt(vv.cvar) AS conc_uci
      FROM grp g LEFT JOIN cc USING (sex, period, x, var) LEFT JOIN vv USING (sex, period, x, var))"""
    return body


STRATA = [("age", "age_group"), ("ethnicity", "grp"), ("Townsend", "quint")]
REL = ("scored_rel AS (SELECT *, score / round(100 * (1 - power(0.98, exp(0.01::DOUBLE * (CAST(age AS DOUBLE) - 60)"
       " + 0.25::DOUBLE * (0 - 4) + 0.3::DOUBLE * 0))), 9) AS relative_risk FROM scored)")
BASE_SCORE = ("round(100 * (1 - power(0.98, exp(0.01::DOUBLE * (CAST(age AS DOUBLE) - 60) + 0.25::DOUBLE * (0 - 4)"
              " + 0.3::DOUBLE * 0))), 9)")
ALLCOLS = ("person_id", "household_id", "sex", "age", "grp", "quint", "region", "linked", "supplier_x",
           "flag_a", "flag_b", "n_rec", "death_date", "bmi", "bmi_cat")
SEX_X = "CASE WHEN sex = 1 THEN 'Males' ELSE 'Females' END || ', P' || CAST(period AS VARCHAR)"
CONC = "round(conc, 6) AS conc, round(conc_lci, 6) AS conc_lci, round(conc_uci, 6) AS conc_uci"
D_ROW = ", ".join(f"round({c}, 6) AS {c}" for c in ("d_stat", "d_lci", "d_uci", "rsq", "rsq_lci", "rsq_uci"))
M_D = "FROM m LEFT JOIN d USING (sex, period, x, var)"
LABELS = (f"{est_ci('conc', 'conc_lci', 'conc_uci')} AS conc_ci, {est_ci('d_stat', 'd_lci', 'd_uci')} AS d_ci, "
          f"{est_ci('rsq', 'rsq_lci', 'rsq_uci')} AS rsq_ci")

ORACLE: dict[str, str] = {
    "scan_cohort": with_cohort("SELECT * EXCLUDE (bmi), round(bmi, 6) AS bmi FROM cohort"),
    "csv_roundtrip": with_cohort("SELECT person_id, sex, age, region, round(bmi, 6) AS bmi FROM cohort"),
    "table_published": with_cohort("SELECT person_id, death_covid, t FROM linked_t"),
    "csv_quarantine": with_cohort(
        "SELECT CASE WHEN ok THEN person_id END AS person_id, CASE WHEN ok THEN age END AS age,"
        " CASE WHEN ok THEN region END AS region, CASE WHEN NOT ok THEN concat_ws('|', person_id,"
        " CASE WHEN person_id % 13 = 0 THEN 'n/a' ELSE CAST(age AS VARCHAR) END, region,"
        " CASE WHEN person_id % 17 = 0 THEN 'more' END) END AS bad_line"
        " FROM (SELECT *, person_id % 13 <> 0 AND person_id % 17 <> 0 AS ok FROM cohort)"),
    "headings": with_cohort(" UNION ALL ".join(
        f"SELECT '{c}' AS \"Variable\", {c} AS \"Level\", count(*) AS \"Count (n)\" FROM cohort GROUP BY {c}"
        for c in ("grp", "quint", "region")).join(["SELECT * FROM (", ")"])),
    "fanout_observed": """
      SELECT 'collapsed' AS source, count(*) AS n_spine, count(*) AS n_linked, 0 AS fanout FROM orders
      UNION ALL SELECT 'raw', (SELECT count(*) FROM orders), count(*), CAST(count(*) <> (SELECT count(*) FROM orders) AS INTEGER)
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    "table_roundtrip": with_cohort("SELECT person_id, death_covid, t, death_date FROM linked_t"),
    "select_by_pattern": with_cohort("SELECT person_id, flag_a, flag_b, n_rec FROM cohort"),
    "shape": with_cohort("SELECT count(*) AS n_rows, CAST(15 AS INTEGER) AS n_cols FROM cohort"),
    "preview": with_cohort("SELECT * EXCLUDE (bmi), round(bmi, 6) AS bmi FROM cohort ORDER BY person_id LIMIT 10"),
    "project": with_cohort("SELECT person_id, sex, age, region FROM cohort"),
    "rename_project": with_cohort("SELECT person_id AS census_person_id, household_id AS household,"
                                  " grp AS ethnicity_9, quint AS town_q, age FROM cohort"),
    "drop_cols": with_cohort("SELECT * EXCLUDE (bmi, bmi_cat, household_id) FROM cohort"),
    "derive_sequential": with_cohort("SELECT person_id, death_date, outcome, death_covid, death_other, t FROM causes"),
    "override_constants": with_cohort("SELECT person_id, flag_a, 0 AS flag_b, 0 AS supplier_x FROM cohort"),
    "baseline_profile": with_cohort("SELECT person_id, age, death_covid, CAST(0 AS BIGINT) AS n_rec, 0 AS flag_a,"
                                    " 0 AS flag_b, CAST(25 AS DOUBLE) AS bmi FROM linked_t"),
    "eligible_cohort": with_cohort("SELECT person_id, age, region, death_date FROM cohort"
                                   " WHERE (death_date IS NULL OR death_date >= DATE '1998-01-01')"
                                   " AND age BETWEEN 19 AND 100 AND region IS NOT NULL AND region <> 'AFRICA'"),
    "deaths_in_period": with_cohort("SELECT person_id, death_date FROM cohort"
                                    " WHERE death_date BETWEEN DATE '1998-01-01' AND DATE '1998-04-08'"),
    "risk_set_entry": with_cohort("SELECT person_id, death_date FROM cohort"
                                  " WHERE death_date IS NULL OR death_date >= DATE '1998-04-09'"),
    "subset_eq": with_cohort("SELECT person_id, sex, age FROM cohort WHERE linked = 1 AND supplier_x = 1"),
    "null_split": with_cohort("SELECT count(*) AS n, 1 AS bmi_missing FROM cohort WHERE bmi IS NULL"
                              " UNION ALL SELECT count(*) AS n, 0 AS bmi_missing FROM cohort WHERE bmi IS NOT NULL"),
    "recode_group": with_cohort(ETH + """
SELECT person_id, eth_code,
  CASE WHEN c = 1 THEN 'White British' WHEN c BETWEEN 2 AND 4 THEN 'White other' WHEN c BETWEEN 5 AND 8 THEN 'Mixed'
       WHEN c = 9 THEN 'Indian' WHEN c = 10 THEN 'Pakistani' WHEN c = 11 THEN 'Bangladeshi' WHEN c = 12 THEN 'Chinese'
       WHEN c = 14 THEN 'Black African' WHEN c = 15 THEN 'Black Caribbean' WHEN c > 15 OR c = 13 THEN 'Other' END
  AS ethnicity_9 FROM eth2"""),
    "recode_code": with_cohort(ETH + """
SELECT person_id, CAST(CASE WHEN c <= 2 THEN c WHEN c IN (3, 4) THEN 3 WHEN c BETWEEN 5 AND 11 THEN c - 1
  WHEN c = 12 THEN 15 WHEN c = 13 THEN 11 WHEN c = 14 THEN 13 WHEN c = 15 THEN 12 WHEN c = 16 THEN 14
  WHEN c IN (17, 18) THEN 16 END AS INTEGER) AS ethnicity FROM eth2"""),
    "bmi_band": with_cohort(f"SELECT person_id, {BMI_BAND} AS bmi_category FROM cohort"),
    "age_band": with_cohort(f"SELECT person_id, {AGE_BAND} AS age_band FROM cohort"),
    "age_interval": with_cohort(f"SELECT person_id, {AGE_INTERVAL} AS age_group FROM cohort"),
    "clean_interval": with_cohort(f"a AS (SELECT person_id, {AGE_INTERVAL} AS age_group FROM cohort)"
                                  f" SELECT person_id, age_group, {clean('age_group')} AS age_gr FROM a"),
    "flags": with_cohort("SELECT person_id, CASE WHEN n_rec >= 5 THEN 1 WHEN NOT (n_rec >= 5) THEN 0 END AS many_records,"
                         " CASE WHEN bmi_cat = 'OBESE' THEN 1 ELSE 0 END AS obese_label FROM cohort"),
    "fill_zero": with_cohort("SELECT person_id, coalesce(flag_a, 0) AS flag_a, coalesce(flag_b, 0) AS flag_b,"
                             " coalesce(n_rec, 0) AS n_rec FROM cohort"),
    "sentinel_null": with_cohort("SELECT person_id, round(nullif(bmi, 0), 6) AS bmi FROM cohort"),
    "safe_cast": with_cohort(ETH + " SELECT person_id, TRY_CAST(substr(grp, 1, 1) AS INTEGER) AS grp_num,"
                             " TRY_CAST(eth_code AS INTEGER) AS eth_num FROM eth"),
    "followup_days": with_cohort("SELECT person_id, t FROM causes"),
    "truncate_outcome": with_cohort("SELECT person_id, l.death_covid AS died, outcome, c.death_covid, death_other"
                                    " FROM causes c JOIN linked l USING (person_id)"),
    "recensor_periods": with_cohort("SELECT person_id, period, death_covid, t FROM pers_period"),
    "one_hot": with_cohort("SELECT person_id, " + ", ".join(
        f"CASE WHEN {col} = '{lv}' THEN 1 ELSE 0 END AS {col}_{slug}" for col, lv, slug in [
            ("grp", "1-URGENT", "1_urgent"), ("grp", "2-HIGH", "2_high"), ("grp", "3-MEDIUM", "3_medium"),
            ("grp", "4-NOT SPECIFIED", "4_not_specified"), ("grp", "5-LOW", "5_low"),
            ("quint", "AUTOMOBILE", "automobile"), ("quint", "BUILDING", "building"),
            ("quint", "FURNITURE", "furniture"), ("quint", "HOUSEHOLD", "household"),
            ("quint", "MACHINERY", "machinery"), ("region", "AFRICA", "africa"), ("region", "AMERICA", "america"),
            ("region", "ASIA", "asia"), ("region", "EUROPE", "europe"), ("region", "MIDDLE EAST", "middle_east")])
        + " FROM cohort"),
    "csv_row_number": with_cohort("SELECT person_id, round(bmi, 6) AS bmi,"
                                  " row_number() OVER (ORDER BY bmi NULLS LAST, person_id) AS row FROM cohort"),
    "natural_join": with_cohort("SELECT person_id, sex, age, death_covid FROM linked"),
    "join_suffix": with_cohort("SELECT person_id, age AS age_x, round(bmi, 6) AS bmi_x, 50 AS age_y,"
                               " CAST(25 AS DOUBLE) AS bmi_y FROM cohort"),
    "collapse": with_cohort("SELECT person_id, CASE WHEN n_rec = 1 THEN 2 ELSE n_rec END AS n_rec FROM cohort"),
    "poly_terms": with_cohort("SELECT person_id, round(CAST(age AS DOUBLE) * age, 6) AS age2,"
                              " round(CAST(age AS DOUBLE) * age * age, 6) AS age3 FROM cohort"),
    "n_pct_label": with_cohort(
        "f AS (SELECT 'region' AS variable, region AS value, count(*) AS n FROM cohort WHERE linked = 1 GROUP BY region),"
        " g AS (SELECT *, CAST(n AS DOUBLE) * 100 / sum(n) OVER () AS pct FROM f)"
        f" SELECT variable, value, n, round(pct, 6) AS pct, {n_pct('n', 'pct')} AS count_label FROM g"),
    "ci_label": with_cohort(
        "g AS (SELECT sex, period, avg(score) AS est, stddev_samp(score) / sqrt(count(*)) AS se FROM scored GROUP BY ALL),"
        " h AS (SELECT sex, period, est, est - 1.96 * se AS lci, est + 1.96 * se AS uci FROM g)"
        f" SELECT sex, period, round(est, 6) AS est, round(lci, 6) AS lci, round(uci, 6) AS uci,"
        f" {est_ci('est', 'lci', 'uci')} AS est_ci FROM h"),
    "enrich_spine": """
SELECT o.o_orderkey AS person_id, c.c_mktsegment, n.n_name, r.r_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "link_sources": with_cohort(S2 + ", " + S3 + """
SELECT o.o_orderkey AS person_id, coalesce(rec.flag_a, 0) AS flag_a, coalesce(rec.flag_b, 0) AS flag_b,
       coalesce(rec.n_rec, 0) AS n_rec, coalesce(s2.flag_a2, 0) AS flag_a2, coalesce(s2.flag_c, 0) AS flag_c,
       coalesce(s3.chemocat, 0) AS chemocat, coalesce(s3.n_line, 0) AS n_line
FROM orders o LEFT JOIN rec ON o.o_orderkey = rec.person_id LEFT JOIN s2 ON o.o_orderkey = s2.person_id
LEFT JOIN s3 ON o.o_orderkey = s3.person_id"""),
    "link_bucketed": with_cohort(S2 + ", " + S3 + """
SELECT o.o_orderkey AS person_id, coalesce(rec.flag_a, 0) AS flag_a, coalesce(rec.flag_b, 0) AS flag_b,
       coalesce(rec.n_rec, 0) AS n_rec, coalesce(s2.flag_a2, 0) AS flag_a2, coalesce(s2.flag_c, 0) AS flag_c,
       coalesce(s3.chemocat, 0) AS chemocat, coalesce(s3.n_line, 0) AS n_line
FROM orders o LEFT JOIN rec ON o.o_orderkey = rec.person_id LEFT JOIN s2 ON o.o_orderkey = s2.person_id
LEFT JOIN s3 ON o.o_orderkey = s3.person_id"""),
    "translate_id": """
SELECT o.o_custkey AS household_id,
       max(TRY_CAST(CASE WHEN l.l_returnflag = 'A' THEN '1' ELSE '0' END AS DOUBLE)) AS flag_a2,
       max(TRY_CAST(CASE WHEN l.l_linestatus = 'O' THEN '1' ELSE '0' END AS DOUBLE)) AS flag_c
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_custkey IS NOT NULL GROUP BY o.o_custkey""",
    "area_index": """
SELECT o.o_orderkey AS person_id, n.n_name AS area_name,
       round(CAST(n.n_nationkey * 7 % 25 AS DOUBLE) / 5 - 2.5, 6) AS town, CAST(n.n_regionkey + 1 AS INTEGER) AS town_q
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "link_keep_null": with_cohort(
        "b AS (SELECT person_id, bmi, bmi_cat FROM cohort WHERE bmi IS NOT NULL)"
        " SELECT c.person_id, round(b.bmi, 6) AS bmi, b.bmi_cat FROM cohort c LEFT JOIN b USING (person_id)"),
    "link_flag": """
SELECT o.o_orderkey AS person_id, coalesce(x.linked_a, 0) AS linked_a FROM orders o LEFT JOIN (
  SELECT l_orderkey, max(CASE WHEN (CASE WHEN l_returnflag = 'A' THEN l_partkey END) IS NOT NULL THEN 1 ELSE 0 END)
         AS linked_a FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey) x ON o.o_orderkey = x.l_orderkey""",
    "combine_sources": with_cohort(S2 + """
SELECT o.o_orderkey AS person_id,
       CAST(coalesce(CASE WHEN rec.flag_a = 1 THEN 1 ELSE s2.flag_a2 END, 0) AS DOUBLE) AS flag_any
FROM orders o LEFT JOIN rec ON o.o_orderkey = rec.person_id LEFT JOIN s2 ON o.o_orderkey = s2.person_id"""),
    "fanout_audit": """
WITH lj AS (SELECT o.o_orderkey AS person_id, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
pk AS (SELECT person_id, count(*) AS c FROM lj GROUP BY person_id),
ns AS (SELECT count(*) AS n_spine FROM orders)
SELECT ns.n_spine, CAST(sum(c) AS BIGINT) AS n_linked, count(*) AS n_keys,
       CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_fanout_keys, max(c) AS max_rows_per_key,
       CAST(CAST(sum(c) AS BIGINT) <> ns.n_spine AS INTEGER) AS fanout
FROM pk, ns GROUP BY ns.n_spine""",
    "dedupe_max": with_cohort(S2 + " SELECT person_id, flag_a2, flag_c, n_line_d AS n_line FROM s2"),
    "dedupe_severity": with_cohort(S3 + " SELECT person_id, chemocat, n_line FROM s3"),
    "sum_all": with_cohort("SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in
                                                 ("flag_a", "flag_b", "n_rec", "supplier_x", "death_covid"))
                           + " FROM linked_t WHERE linked = 1"),
    "null_profile": with_cohort("SELECT " + ", ".join(
        f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in ALLCOLS) + " FROM cohort"),
    "describe_all": with_cohort(
        DESC + ", pop AS (SELECT 'all' AS population, * FROM d UNION ALL"
        " SELECT 'p1' AS population, * FROM d WHERE death_date BETWEEN DATE '1998-01-01' AND DATE '1998-04-08' AND death_covid = 1"
        " UNION ALL SELECT 'p2' AS population, * FROM d WHERE death_date BETWEEN DATE '1998-04-09' AND DATE '1998-07-06'"
        " AND death_covid = 1), " + freq_sql("x0 AS (SELECT 1)", "pop", CATEGORICAL, True) + ", "
        + num_sql("pop", CONTINUOUS, True)
        + f" SELECT population, variable, value, n, round(pct, 6) AS pct, CAST(NULL AS DOUBLE) AS mean,"
          f" CAST(NULL AS DOUBLE) AS sd, {n_pct('n', 'pct')} AS label FROM catf"
          f" UNION ALL SELECT population, variable, CAST(NULL AS VARCHAR) AS value, n, CAST(NULL AS DOUBLE) AS pct,"
          f" round(mean, 6) AS mean, round(sd, 6) AS sd, {short('mean')} || ' (' || {short('sd')} || ')' AS label FROM numf"),
    "describe_cat": with_cohort(
        freq_sql(DESC, "d", ["sex", "grp", "quint", "region", "bmi_cat"], False)
        + f" SELECT variable, value, n, round(pct, 6) AS pct, {n_pct('n', 'pct')} AS count_label FROM catf"),
    "describe_num": with_cohort(
        DESC + ", " + num_sql("d", CONTINUOUS, False)
        + f" SELECT variable, n, round(mean, 6) AS mean, round(sd, 6) AS sd,"
          f" {short('mean')} || ' (' || {short('sd')} || ')' AS mean_sd FROM numf"),
    "group_mean": with_cohort(BC + " SELECT bmi_cat, sex, round(avg(bmi), 6) AS prediction_mm FROM bc"
                              " WHERE bmi IS NOT NULL AND bmi_cat IS NOT NULL AND sex IS NOT NULL GROUP BY ALL"),
    "impute_group_mean": with_cohort(
        BC + ", gm AS (SELECT bmi_cat, sex, avg(bmi) AS m FROM bc WHERE bmi IS NOT NULL AND bmi_cat IS NOT NULL"
        " AND sex IS NOT NULL GROUP BY ALL)"
        " SELECT person_id, round(CASE WHEN bc.bmi IS NULL AND bc.bmi_cat IS NOT NULL THEN gm.m ELSE bc.bmi END, 6)"
        " AS bmi FROM bc LEFT JOIN gm USING (bmi_cat, sex)"),
    "split_union": with_cohort(
        BC + ", m AS (SELECT sex, avg(bmi) AS mb FROM bc WHERE bmi IS NOT NULL AND sex IS NOT NULL GROUP BY sex)"
        " SELECT person_id, sex, round(bmi, 6) AS bmi, 0 AS imputed FROM bc WHERE bmi IS NOT NULL"
        " UNION ALL SELECT person_id, sex, round(m.mb, 6) AS bmi, 1 AS imputed FROM bc LEFT JOIN m USING (sex)"
        " WHERE bc.bmi IS NULL"),
    "coalesce_pred": with_cohort(
        BC + ", m AS (SELECT sex, avg(bmi) AS mb FROM bc WHERE bmi IS NOT NULL AND sex IS NOT NULL GROUP BY sex)"
        " SELECT bc.person_id, round(m.mb, 6) AS prediction_lm FROM bc LEFT JOIN m ON bc.sex = m.sex AND bc.sex IN (0, 1)"),
    "imputer_mse": with_cohort(
        BC + f", lab AS (SELECT *, CASE WHEN substr(md5(CAST(person_id AS VARCHAR) || 'split'), 1, 8) < '{SPLIT70}'"
        " THEN 'training' ELSE 'test' END AS split FROM bc WHERE bmi IS NOT NULL AND bmi_cat IS NOT NULL),"
        " tr AS (SELECT * FROM lab WHERE split = 'training'), te AS (SELECT * FROM lab WHERE split = 'test'),"
        " mm AS (SELECT bmi_cat, sex, avg(bmi) AS pm FROM tr WHERE sex IS NOT NULL GROUP BY ALL),"
        " co AS (SELECT sex, regr_intercept(bmi, age) AS b0, regr_slope(bmi, age) AS b1 FROM tr"
        " WHERE sex IS NOT NULL AND age IS NOT NULL GROUP BY sex)"
        " SELECT round(avg(power(te.bmi - (co.b0 + co.b1 * te.age), 2)), 6) AS mse_lm,"
        " round(avg(power(te.bmi - mm.pm, 2)), 6) AS mse_mm, count(*) AS n_test"
        " FROM te LEFT JOIN mm USING (bmi_cat, sex) LEFT JOIN co USING (sex)"),
    "ols_fit": with_cohort(BC + " SELECT sex, round(regr_intercept(bmi, age), 6) AS intercept,"
                           " round(regr_slope(bmi, age), 6) AS slope, count(*) AS n, round(regr_r2(bmi, age), 6) AS r2 FROM bc"
                           " WHERE bmi IS NOT NULL AND age IS NOT NULL AND sex IS NOT NULL GROUP BY sex"),
    "ols_summary": with_cohort(ols.summary_sql(BC), recursive=True),
    "ols_impute": with_cohort(ols.impute_sql(BC, two_stage=False), recursive=True),
    "impute_two_stage": with_cohort(ols.impute_sql(BC, two_stage=True), recursive=True),
    "imputer_mse_full": with_cohort(ols.holdout_sql(BC, SPLIT70), recursive=True),
    "impute_audit": with_cohort(
        BC + ", gm AS (SELECT bmi_cat, sex, avg(bmi) AS m FROM bc WHERE bmi IS NOT NULL AND bmi_cat IS NOT NULL"
        " AND sex IS NOT NULL GROUP BY ALL),"
        " s1 AS (SELECT bc.person_id, bc.sex, bc.age,"
        " CASE WHEN bc.bmi IS NULL AND bc.bmi_cat IS NOT NULL THEN gm.m ELSE bc.bmi END AS bmi,"
        " CASE WHEN bc.bmi IS NOT NULL THEN 0 WHEN bc.bmi IS NULL AND bc.bmi_cat IS NOT NULL AND gm.m IS NOT NULL"
        " THEN 1 END AS imputed FROM bc LEFT JOIN gm USING (bmi_cat, sex)),"
        " co AS (SELECT sex, regr_intercept(bmi, age) AS b0, regr_slope(bmi, age) AS b1 FROM s1"
        " WHERE bmi IS NOT NULL AND sex IS NOT NULL GROUP BY sex),"
        " s2 AS (SELECT s1.sex, CASE WHEN s1.bmi IS NULL THEN co.b0 + co.b1 * s1.age ELSE s1.bmi END AS bmi,"
        " CASE WHEN s1.bmi IS NULL THEN 2 ELSE s1.imputed END AS imputed FROM s1 LEFT JOIN co USING (sex))"
        " SELECT sex, imputed, count(*) AS n, round(avg(bmi), 6) AS mean, round(stddev_samp(bmi), 6) AS sd,"
        " round(min(bmi), 6) AS min, round(max(bmi), 6) AS max FROM s2 GROUP BY sex, imputed"),
    "hash_split": with_cohort(f"SELECT person_id, CASE WHEN substr(md5(CAST(person_id AS VARCHAR) || 'split'), 1, 8)"
                              f" < '{SPLIT70}' THEN 'training' ELSE 'test' END AS split FROM cohort"),
    "case_sample": with_cohort(
        "SELECT person_id, sex, period, death_covid, CAST(CASE WHEN death_covid = 1 THEN 1 ELSE 2 END AS DOUBLE)"
        f" AS weight FROM scored WHERE death_covid = 1 OR substr(md5(CAST(person_id AS VARCHAR) || '123'), 1, 8)"
        f" < '{HALF}'"),
    "risk_score": with_cohort("SELECT person_id, period, round(a, 6) AS a, round(score, 6) AS score FROM scored"),
    "relative_risk": with_cohort(
        f"b AS (SELECT *, {BASE_SCORE} AS bs FROM scored)"
        " SELECT person_id, period, round(score, 6) AS score, round(bs, 6) AS baseline_score,"
        " round(score / bs, 6) AS relative_risk FROM b"),
    "ntile20": with_cohort("SELECT person_id, sex, period, CAST(NTILE(20) OVER (PARTITION BY sex, period"
                           " ORDER BY score, person_id) AS INTEGER) AS q FROM scored"),
    "ntile100": with_cohort("SELECT person_id, sex, period, CAST(NTILE(100) OVER (PARTITION BY sex, period"
                            " ORDER BY score, person_id) AS INTEGER) AS q FROM scored"),
    "threshold_table": threshold_sql(20),
    "capture_curve": with_cohort(tile_groups(20) + " SELECT sex, period, q, deaths, cum_deaths,"
                                 " round(cum_deaths / nullif(all_deaths, 0), 6) AS cum_deaths_p FROM cap"),
    "top_centiles": threshold_sql(100, "q >= 75"),
    "calibration_table": with_cohort(tile_groups(20) + " SELECT sex, period, q, round(predicted, 6) AS predicted,"
                                     " round(observed, 6) AS observed FROM tg"),
    "calibration_long": calibration_long_sql(20),
    "top_centiles_rel": with_cohort(REL + ", " + tile_groups(100, "scored_rel", "relative_risk").strip()
                                    + " SELECT sex, period, q, round(mn, 6) AS min, deaths, total, cum_deaths,"
                                    " round(cum_deaths / nullif(all_deaths, 0), 6) AS cum_deaths_p FROM cap"
                                    " WHERE q >= 75"),
    "calibration_rel": with_cohort(REL + ", " + tile_groups(20, "scored_rel", "relative_risk").strip()
                                   + " SELECT sex, period, q, 'Predicted' AS type, round(predicted, 6) AS value FROM tg"
                                   " UNION ALL SELECT sex, period, q, 'Observed' AS type, round(observed, 6) AS value FROM tg"),
    "capture_at_k": with_cohort(tile_groups(100) + """
SELECT sex, period, CAST(100 - q + 1 AS INTEGER) AS q, CASE WHEN sex = 0 THEN 'Women' WHEN sex = 1 THEN 'Men' END AS sex_label,
       deaths, cum_deaths, round(cum_deaths / nullif(all_deaths, 0) * 100, 6) AS cum_deaths_pct
FROM cap WHERE q >= 75 AND 100 - q + 1 = 5"""),
    "strata_values": with_cohort("SELECT DISTINCT x, var FROM (SELECT 'all' AS x, 'all' AS var FROM scored"
                                 " UNION ALL SELECT 'age', age_group FROM scored UNION ALL SELECT 'ethnicity', grp"
                                 " FROM scored UNION ALL SELECT 'Townsend', quint FROM scored)"),
    "union_tagged": with_cohort(f"SELECT sex, period, count(*) AS n, CAST(sum(death_covid) AS BIGINT) AS events,"
                                f" {SEX_X} AS x FROM scored GROUP BY sex, period"),
    "concordance": with_cohort(metrics_sql([]) + """
SELECT sex, period, n, events, round(con, 6) AS con, round(dis, 6) AS dis, round(tied, 6) AS tied,
       round(conc, 6) AS conc FROM m"""),
    "brier": with_cohort("SELECT sex, period, round(avg(power(score / 100 - death_covid, 2)), 6) AS brier"
                         " FROM scored GROUP BY sex, period"),
    "metrics_by_strata": with_cohort(metrics_sql(STRATA) + "," + d_sql(STRATA) + f"""
SELECT sex, period, x, var, n, events, round(con, 6) AS con, round(dis, 6) AS dis, round(tied, 6) AS tied,
       {CONC}, {D_ROW}, round(brier, 6) AS brier {M_D}"""),
    "metrics_subset": with_cohort(metrics_sql([], "supplier_x = 1") + "," + d_sql([], "supplier_x = 1") + f"""
SELECT sex, period, x, var, n, events, {CONC}, {D_ROW}, round(brier, 6) AS brier {M_D}"""),
    "metrics_summary": with_cohort(metrics_sql([]) + "," + d_sql([]) + f"""
SELECT sex, period, {SEX_X} AS x, {CONC}, {D_ROW}, round(brier, 6) AS brier, {LABELS} {M_D}"""),
    "metrics_row": with_cohort(metrics_sql([]) + "," + d_sql([]) + f"""
SELECT sex, period, {CONC}, {D_ROW}, round(brier, 6) AS brier, {LABELS} {M_D}"""),
    "d_statistic": with_cohort(d_sql([]) + """
SELECT sex, period, round(d_stat, 6) AS d_stat, round(d_se, 6) AS d_se, round(d_lci, 6) AS d_lci, round(d_uci, 6) AS d_uci
FROM d"""),
    "r2_d": with_cohort(d_sql([]) + """
SELECT sex, period, round(rsq, 6) AS rsq, round(rsq_lci, 6) AS rsq_lci, round(rsq_uci, 6) AS rsq_uci,
       CASE WHEN d_lci < 0 THEN 1 ELSE 0 END AS lci_folded FROM d"""),
    "plot_cstat_age": with_cohort(metrics_sql([("age", "age_group")]) + f"""
SELECT sex, period, var, {clean('var')} AS age_gr, round(conc, 6) AS conc, round(conc_lci, 6) AS conc_lci,
       round(conc_uci, 6) AS conc_uci FROM m WHERE x = 'age'"""),
}
