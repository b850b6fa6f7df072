"""Review semantics: state rules, reasons, agreement of passes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds (a null rule does not)."""
    out = F.lit(otherwise)
    for c, name in reversed(rules):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def status_counts(df: DataFrame, group: list[str], status: str, domain: list[str]) -> DataFrame:
    """n_<value> for each value of the domain, n_other and total."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in domain]
    other = F.count_if(~F.coalesce(F.col(status).isin(domain), F.lit(False))).alias("n_other")
    return df.groupBy(*group).agg(*counts, other, F.count(F.lit(1)).alias("total"))


def strict_pass(status: Column, confidence: Column, issues: Column, corrections: Column) -> Column:
    """auto_pass with high confidence and explicitly empty lists; a missing list fails."""
    empty = lambda a: F.coalesce(F.size(a) == 0, F.lit(False))
    return F.coalesce((status == "auto_pass") & (confidence == "high"), F.lit(False)) & empty(issues) & empty(corrections)


def agreement(primary_a: Column, primary_b: Column, high_a: Column, high_b: Column) -> Column:
    """approved if both passes are sure and agree, disputed if they differ, pending otherwise."""
    return F.when(F.coalesce((primary_a == primary_b) & high_a & high_b, F.lit(False)), "approved").when(~primary_a.eqNullSafe(primary_b), "disputed").otherwise("pending")


def gate(df: DataFrame, group: list[str], reasons: Column) -> DataFrame:
    """Per group: n, n_eligible, and admitted if there are rows and all are eligible (no reasons)."""
    ok = F.size(reasons) == 0
    return df.withColumn("_ok", ok).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("n_eligible"), F.every("_ok").alias("admitted"))
