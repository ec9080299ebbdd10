"""riskweave: cohort linkage, imputation and risk-score validation as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function (composable with
``df.transform``) whose grouping keys are data, not driver loops.  Only small,
bounded summaries (split points, per-day sums, coefficient tables) ever reach
the driver.
"""

__all__ = ["session", "sources", "functions", "operators", "plans"]
