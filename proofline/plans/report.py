"""Per-assessment report from check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.exprs import n_if, ts
from proofline.functions.vocab import STATUSES
from proofline.plans.assessments import Assessments

KEY = Assessments.KEY


def metric_rollup(results: DataFrame) -> DataFrame:
    """``count_`` metrics summed by name over the checks of an assessment."""
    return (
        results.select(KEY, F.explode("metrics").alias("metric", "value"))
        .where(F.startswith("metric", F.lit("count_")))
        .groupBy(KEY, "metric")
        .agg(F.sum("value").alias("value"))
    )


# Counts of distinct runs, which may be in several tenants or environments.
NOT_ADDITIVE = ("count_semantic_runs", "count_semantic_runs_correlated")


def rollup(results: DataFrame) -> DataFrame:
    """``count_`` metrics per tenant and environment, per tenant, and over all, in one pass.

    ``level`` is the grouping id over (tenant_id, environment, metric): 0, 2 and 6. Counts of
    distinct runs do not add up and are left out.
    """
    told = results.select("tenant_id", "environment", F.explode("metrics").alias("metric", "value")).where(
        F.startswith("metric", F.lit("count_")) & ~F.col("metric").isin(*NOT_ADDITIVE)
    )
    tenant, environment, metric = F.col("tenant_id"), F.col("environment"), F.col("metric")
    sets = [[tenant, environment, metric], [tenant, metric], [metric]]
    return told.groupingSets(sets, tenant, environment, metric).agg(
        F.sum("value").alias("value"), F.grouping_id().alias("level")
    )


def _counts() -> list[Column]:
    return [n_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES]


def _overall(counted: DataFrame) -> DataFrame:
    return counted.selectExpr(
        "*",
        "case when n_fail + n_error > 0 then 'NON_CONFORMANT' when n_partial > 0 then 'PARTIAL' "
        "else 'CONFORMANT' end as overall_status",
        "n_pass as must_pass_checks_passing",
        "n_fail + n_error as must_pass_checks_failing",
        "n_partial as open_partial_checks",
        "n_fail + n_error > 0 as run_failed",
    )


def status_counts(results: DataFrame) -> DataFrame:
    """How many checks ended in each status, and the overall status."""
    return _overall(results.groupBy(KEY).agg(*_counts()))


def build_report(
    results: DataFrame,
    assessments: Assessments,
    generated_at,
    generated_by: str = "proofline",
    report_version: str = "1.1",
) -> DataFrame:
    """One row per assessment: metadata, every check, metrics and summary.

    A check's empty fields are null, so a JSON sink leaves them out.
    """
    fields = [
        "check_id", "status", "classification", "title", "control", "tier", "metrics",
        "manual_steps", "automated_finding", "error", "notes", "evidence_refs",
    ]
    lists = {f: F.when(F.size(f) > 0, F.col(f)).alias(f) for f in ("manual_steps", "evidence_refs")}
    entry = F.struct(*[lists.get(f, F.col(f)) for f in fields])
    # One grouping does it all, so the checks are run once. The groups are
    # bounded: one row per registered check, a few metrics each.
    by_id = lambda a, b: F.when(a["check_id"] < b["check_id"], -1).otherwise(1)
    grouped = _overall(
        results.groupBy(KEY).agg(
            F.array_sort(F.collect_list(entry), by_id).alias("checks"), *_counts()
        )
    )
    entries = (
        "filter(flatten(transform(checks, c -> coalesce(map_entries(c.metrics), array()))), "
        "e -> startswith(e.key, 'count_'))"
    )
    rolled = grouped.withColumn("entries", F.expr(entries)).withColumn(
        "metrics",
        F.expr(
            "map_from_entries(transform(array_distinct(transform(entries, e -> e.key)), k -> "
            "struct(k, aggregate(entries, 0d, (s, e) -> s + if(e.key = k, e.value, 0d)))))"
        ),
    )
    summary = F.struct(
        "overall_status",
        F.struct(*[F.col(f"n_{s.lower()}").alias(s) for s in STATUSES]).alias("counts"),
        "must_pass_checks_passing",
        "must_pass_checks_failing",
        "open_partial_checks",
        F.lit(
            "Computed from the evidence store. PARTIAL marks checks whose listed manual "
            "evidence is still owed. Not a formal audit or certification."
        ).alias("attestation"),
    )
    return (
        assessments.frame.select(
            KEY, "tenant_id", "environment", F.col("tier").alias("autonomy_tier"),
            F.col("window_days").alias("assessment_window_days"),
        )
        .join(rolled.withColumn("summary", summary), KEY)
        .select(
            ts(generated_at).alias("generated_at"),
            F.lit(generated_by).alias("generated_by"),
            F.lit(report_version).alias("report_version"),
            KEY, "tenant_id", "environment", "autonomy_tier", "assessment_window_days",
            "checks", "metrics", "summary", "run_failed",
        )
    )


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Store reports as JSON or Parquet, one directory per tenant.

    Only the directories of the tenants in ``report`` are replaced.
    """
    if fmt not in ("json", "parquet"):
        raise ValueError(f"format must be json or parquet, not {fmt!r}")
    # Partition columns are not in the files, so a copy names the directory.
    (
        report.withColumn("tenant", F.col("tenant_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tenant")
        .format(fmt)
        .save(path)
    )
