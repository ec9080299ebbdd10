"""Fixture views: the study's logical tables built from the driver's TPC-H-like tables.

The real study reads a census spine, clinical sources, an area index and an id
lookup.  The test data has none of these, so each logical table is defined over
``orders``/``lineitem``/``customer``/``nation``/``region`` (mapping in
FIXTURES.md).  Everything is lazy DataFrame code that Catalyst can prune and push
down; nothing is materialised here.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the fixture study (FIXTURES.md section 3).
STUDY_START = dt.date(1998, 1, 1)
STUDY_END = dt.date(1998, 7, 6)
PERIODS = ((1, dt.date(1998, 1, 1), dt.date(1998, 4, 8)),
           (2, dt.date(1998, 4, 9), dt.date(1998, 7, 6)))

#: The categories of the fixture's coded columns, as a study's code book lists them.
LEVELS = {"grp": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
          "quint": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
          "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}


def ts(d: dt.date):
    """A ``timestamp_ntz`` literal for comparisons against the raw date columns."""
    return F.lit(d.isoformat()).cast("timestamp_ntz")


@dataclass
class Tables:
    """Lazy handles to the driver tables under one scale-factor folder."""

    spark: SparkSession
    base: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "base"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.base, name)
        return self._cache[name]


def clinical_records(lineitem: DataFrame) -> DataFrame:
    """Multi-row clinical source collapsed to one row per person (A2 on the fixture).

    flag_a = any discount >= 0.09, flag_b = any tax >= 0.08, n_rec = record count,
    death_date = first return ('R') shipped on or after the study start.
    """
    return (lineitem
            .where(F.col("l_orderkey").isNotNull())
            .groupBy(F.col("l_orderkey").alias("person_id"))
            .agg(F.count(F.lit(1)).alias("n_rec"),
                 F.max(F.when(F.col("l_discount") >= 0.09, 1).otherwise(0)).alias("flag_a"),
                 F.max(F.when(F.col("l_tax") >= 0.08, 1).otherwise(0)).alias("flag_b"),
                 F.to_date(F.min(F.when((F.col("l_returnflag") == "R")
                                        & (F.col("l_shipdate") >= ts(STUDY_START)),
                                        F.col("l_shipdate")))).alias("death_date")))


def spine(t: Tables) -> DataFrame:
    """The person spine: one row per order with household, demographic and area codes."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        "o_orderpriority")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
            .join(r, F.col("n_regionkey") == r.r_regionkey, "left"))


def bmi_expr() -> tuple:
    """BMI value and label with the fixture's null / zero-sentinel injection rules."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    bmi = (F.when(key % 7 == 0, F.lit(None).cast("double"))
           .when(key % 11 == 0, F.lit(0.0))
           .otherwise(15 + price / 15000))
    cat = (F.when(key % 5 == 0, F.lit(None).cast("string"))
           .when(price < 52500, "UNDERWEIGHT")
           .when(price < 150000, "IDEAL")
           .when(price < 225000, "OVERWEIGHT")
           .otherwise("OBESE"))
    return bmi, cat


def cohort(t: Tables) -> DataFrame:
    """The linked cohort view of FIXTURES.md (one row per person, all ids distinct)."""
    bmi, bmi_cat = bmi_expr()
    rec = clinical_records(t.lineitem)
    s = spine(t)
    return (s.join(rec, s.o_orderkey == rec.person_id, "left")
            .select(F.col("o_orderkey").alias("person_id"),
                    F.col("o_custkey").alias("household_id"),
                    (F.col("c_nationkey") % 2).cast("int").alias("sex"),
                    (19 + F.col("o_orderkey") % 82).cast("int").alias("age"),
                    F.col("o_orderpriority").alias("grp"),
                    F.col("c_mktsegment").alias("quint"),
                    F.col("r_name").alias("region"),
                    F.when(rec.person_id.isNull(), 0).otherwise(1).alias("linked"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("supplier_x"),
                    "flag_a", "flag_b", "n_rec", "death_date",
                    bmi.alias("bmi"), bmi_cat.alias("bmi_cat")))


def death_causes(lineitem: DataFrame) -> DataFrame:
    """Cause of death per person who died: 'Not COVID' if the supplier key of the line
    that gives the death date (the lowest line number of that time) is a multiple of 4."""
    died = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= ts(STUDY_START))
    first = F.min(F.struct("l_shipdate", "l_linenumber", "l_suppkey"))
    return (lineitem.where(died & F.col("l_orderkey").isNotNull())
            .groupBy(F.col("l_orderkey").alias("person_id")).agg(first.alias("_first"))
            .select("person_id", F.when(F.col("_first.l_suppkey") % 4 == 0, "Not COVID").otherwise("COVID")
                    .alias("death_cause")))


def second_source(lineitem: DataFrame) -> DataFrame:
    """A second per-person clinical source (the GP-style flags): string-coded flags.

    flag_a2 = any returnflag 'A' line, flag_c = any line status 'O', coded as
    strings '0'/'1' the way the study's sources arrive; several rows per person.
    """
    return lineitem.select(
        F.col("l_orderkey").alias("person_id"),
        F.when(F.col("l_returnflag") == "A", "1").otherwise("0").alias("flag_a2"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("0").alias("flag_c"),
        F.col("l_returnflag").alias("severity_code"),
        F.col("l_linenumber").alias("n_line"))


def area_index(t: Tables) -> DataFrame:
    """Small reference table keyed by area code (nation): deprivation score and quintile."""
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return n.select(F.col("n_nationkey").alias("area_code"),
                    F.col("n_name").alias("area_name"),
                    ((F.col("n_nationkey") * 7 % 25) / 5.0 - 2.5).alias("town"),
                    (F.col("n_regionkey") + 1).cast("int").alias("town_q"))
