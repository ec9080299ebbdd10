"""The fixture study as reusable plan pieces: linked cohort -> periods -> scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recode
from ..operators import cohort as co
from ..operators import score as sc
from ..sources import fixtures as fx

SEX_NAMES = {1: "Males", 0: "Females"}
# Baseline (reference) profile for relative risk: every record-derived term at
# its lowest level, bmi at 25; person, age and outcome are kept.
PROFILE_KEEPS = ["person_id", "household_id", "sex", "age", "linked", "supplier_x", "death_covid", "t"]
PROFILE_REFERENCE = {"bmi": 25.0}


def tables(spark: SparkSession, sf_dir: str) -> fx.Tables:
    return fx.Tables(spark, sf_dir)


def linked(t: fx.Tables) -> DataFrame:
    """Fixture cohort with the study-level outcome (death_covid, t)."""
    return co.add_outcome(fx.cohort(t), fx.STUDY_START, fx.STUDY_END)


def linked_causes(t: fx.Tables) -> DataFrame:
    """Fixture cohort with competing deaths: outcome, death_covid, death_other, t."""
    known = fx.cohort(t).join(fx.death_causes(t.lineitem), "person_id", "left")
    known = known.withColumn("death_cause", F.coalesce("death_cause", F.lit(co.ALIVE)))
    return co.add_outcome(known, fx.STUDY_START, fx.STUDY_END, cause_col="death_cause")


def periods(t: fx.Tables) -> DataFrame:
    """One row per person and study period with the re-censored (t, death_covid)."""
    return co.recensor(linked(t), fx.PERIODS)


# Scores are compared with another engine's, which differ in the last bits of exp and pow.
SCORE_DIGITS = 9


def scored(t: fx.Tables, linked_only: bool = True) -> DataFrame:
    """Scores per person and period (the study's ``*_death_scores_p*`` tables)."""
    df = periods(t)
    if linked_only:
        df = df.where(F.col("linked") == 1)
    df = sc.risk_score(df, digits=SCORE_DIGITS)
    return df.select("person_id", "sex", "period", "t", "death_covid", "age", "a", "score",
                     "linked", "supplier_x", "grp", "quint", "region",
                     recode.age_interval(F.col("age")).alias("age_group"))
