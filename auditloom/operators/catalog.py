"""The rule catalog, rule overrides and the evaluation of everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import page_rules, site_rules
from auditloom.plans.model import ISSUE, Crawl


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(r.id, r.category, r.severity, "page", "free", False) for r in page_rules.RULES] + [(r.id, r.category, r.severity, "site", "free", r.whole) for r in site_rules.RULES]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, scope string, min_tier string, whole_crawl boolean")


def known() -> set[str]:
    return {r.id for r in page_rules.RULES} | {r.id for r in site_rules.RULES}


def fields(only: set[str] | None = None) -> frozenset[str]:
    """The fields that the parser must find for an audit by these rules, or by all."""
    return page_rules.fields(only) | site_rules.fields(only)


def check_overrides(overrides: dict) -> dict:
    """``{"disable": [...], "severity": {rule: severity}}``, ids in any case; unknown ids, and ids in both, are errors."""
    disable = {x.upper() for x in overrides.get("disable", [])}
    severity = {k.upper(): v for k, v in overrides.get("severity", {}).items()}
    if bad := (disable | set(severity)) - known():
        raise ValueError(f"unknown rules: {sorted(bad)}")
    if both := disable & set(severity):
        raise ValueError(f"rules both disabled and changed: {sorted(both)}")
    return {"disable": sorted(disable), "severity": severity}


def apply_overrides(issues: DataFrame, overrides: dict) -> DataFrame:
    o = check_overrides(overrides)
    out = issues.where(~F.col("rule_id").isin(o["disable"])) if o["disable"] else issues
    severity = F.col("severity")
    for k, v in sorted(o["severity"].items()):
        severity = F.when(F.col("rule_id") == k, v).otherwise(severity)
    return out.withColumn("severity", severity)


def audit(crawl: Crawl, only: set[str] | None = None, overrides: dict | None = None) -> DataFrame:
    """All findings of a crawl: page rules in one narrow pass, site rules as queries."""
    out = page_rules.evaluate(crawl.pages, only)
    site = site_rules.evaluate(crawl, only)
    if site is not None:
        out = out.unionByName(site)
    return apply_overrides(out, overrides) if overrides else out


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE)
