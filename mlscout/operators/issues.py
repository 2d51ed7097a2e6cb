"""Data-quality rules over a profile, and the preparation steps they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlscout.functions.text import number_text
from mlscout.operators.profile import Profile

# Rule thresholds.
HIGH_MISSING_PCT = 50
HIGH_CARDINALITY = 10
MIN_ABS_MEAN = 1e-10
MAX_VARIATION = 0.01

ISSUE_COLUMNS = ["column", "issue_type", "description", "severity", "position"]

# Issue type -> lead of the suggested action.
PREP_ACTIONS = [
    ("high_missing", "Drop or impute: "),
    ("high_cardinality", "Encode or pool the categories of: "),
    ("near_zero_variance", "Consider dropping (almost constant): "),
]
NO_STEPS = "No preparation needed: no issue was found."


def _rule(
    table: DataFrame, seq: int, issue: str, severity: str, keep: Column, text: Column
) -> DataFrame:
    return table.filter(keep).select(
        F.lit(seq).alias("rule"),
        "position",
        "column",
        F.lit(issue).alias("issue_type"),
        text.alias("description"),
        F.lit(severity).alias("severity"),
    )


def _ordered_issues(profile: Profile) -> DataFrame:
    pct = F.col("pct_missing")
    out = _rule(
        profile.missing,
        1,
        "high_missing",
        "high",
        pct > HIGH_MISSING_PCT,
        F.concat(number_text(pct, 1), F.lit("% missing values")),
    )
    if profile.categorical is not None:
        unique = F.col("n_unique")
        out = out.unionByName(
            _rule(
                profile.categorical,
                2,
                "high_cardinality",
                "medium",
                unique > HIGH_CARDINALITY,
                F.concat(unique.cast("string"), F.lit(" unique values")),
            )
        )
    if profile.numeric is not None:
        variation = F.abs(F.try_divide("sd", "mean"))
        out = out.unionByName(
            _rule(
                profile.numeric,
                3,
                "near_zero_variance",
                "low",
                (F.abs("mean") > MIN_ABS_MEAN) & (variation < MAX_VARIATION),
                F.concat(F.lit("Coefficient of variation = "), number_text(variation, 4)),
            )
        )
    return out


def find_issues(profile: Profile) -> DataFrame:
    """Issues in rule order, then column order (``position`` is the column's place)."""
    return _ordered_issues(profile).orderBy("rule", "position").select(*ISSUE_COLUMNS)


def prep_steps(issues: DataFrame) -> DataFrame:
    """One action line per issue type; a single line when there is no issue."""
    action = F.lit("Review: ")
    for issue, lead in PREP_ACTIONS:
        action = F.when(F.col("issue_type") == issue, F.lit(lead)).otherwise(action)
    # one entry per flagged column, in column order
    flagged = F.sort_array(F.collect_list(F.struct("position", "column")))
    steps = issues.groupBy("issue_type").agg(
        F.count("*").alias("n"), F.array_join(flagged["column"], ", ").alias("columns")
    )
    steps = steps.select("issue_type", "n", F.concat(action, "columns").alias("step"))
    nothing = issues.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("none").alias("issue_type"), "n", F.lit(NO_STEPS).alias("step")
    )
    return steps.unionByName(nothing).orderBy("issue_type")
