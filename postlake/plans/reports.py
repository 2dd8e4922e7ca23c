"""Monthly service-level reports.  Inputs are logs and run histories; what comes out, and
whatever is ordered on the way, has one row per month, run or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake import schema as S
from postlake.functions.text import safe_ratio
from postlake.operators import rollup
from postlake.operators.sli import SLI_MINUTES, SLI_WINDOW, breach_runs, counts, p95, ratios


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _days(month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.to_date(month, "yyyy-MM")))


def ready_probes(log: DataFrame) -> DataFrame:
    """The readiness probes of a request log."""
    return log.filter(F.col("path") == "/ready").select("ts", "status")


def error_budget(probes: DataFrame) -> DataFrame:
    """Availability per month from readiness probes (``ts``, ``status``), the downtime it
    may have, and how much of that is used up."""
    ok = F.count_if(F.col("status").between(200, 299))
    allowed = 1 - S.SLO_AVAILABILITY
    used = (1 - F.col("availability")) / F.lit(allowed)
    return (
        probes.groupBy(_month(F.col("ts")).alias("month"))
        .agg(F.count(F.lit(1)).alias("probes"), ok.alias("probes_ok"))
        .withColumn("availability", safe_ratio(F.col("probes_ok"), F.col("probes")))
        .withColumn("budget_seconds", budget_seconds(_days(F.col("month"))))
        .withColumn("consumed_ratio", used)
        .withColumn("freeze", F.col("consumed_ratio") > S.BUDGET_FREEZE_RATIO)
        .withColumn("stop", F.col("consumed_ratio") > S.BUDGET_STOP_RATIO)
    )


def budget_seconds(days: Column) -> Column:
    """Whole seconds of downtime the availability target leaves in a period."""
    thousandths = round((1 - S.SLO_AVAILABILITY) * 1000)
    return F.floor(days * 86_400 * thousandths / 1000)


def monthly_indicators(log: DataFrame) -> DataFrame:
    return (
        log.groupBy(_month(F.col("ts")).alias("month"))
        .agg(*counts(), p95().alias("p95_ms"))
        .select("month", "requests", "errors", "not_found", *ratios(), "p95_ms")
    )


def stored_indicators(rows: DataFrame) -> DataFrame:
    """``monthly_indicators`` from stored indicators (``operators.rollup``) instead of a log."""
    month = _month(F.col("window_start")).alias("month")
    return rollup.indicators(rollup.merged(rows, "month")).select(
        month, "requests", "errors", "not_found", "error_rate", "not_found_ratio", "p95_ms"
    )


def monthly_freshness(runs: DataFrame) -> DataFrame:
    """The longest time without a successful update inside each month, in hours.

    Months run from the first success to the last run of any outcome.  A gap counts in every
    month it touches, cut at the month's edges; the time since the last success is a gap too.
    """
    order = Window.orderBy("run_finished_at")  # one row per run
    gaps = (
        runs.withColumn("_end", F.max("run_finished_at").over(Window.partitionBy()))
        .filter("status = 'success' AND run_finished_at IS NOT NULL")
        .withColumn("_next", F.coalesce(F.lead("run_finished_at").over(order), "_end"))
    )
    first, last = F.date_trunc("month", "run_finished_at"), F.date_trunc("month", "_next")
    months = gaps.withColumn("_month", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))
    low = F.greatest("run_finished_at", "_month")
    high = F.least(F.col("_next"), F.col("_month") + F.expr("INTERVAL 1 MONTH"))
    hours = (F.unix_micros(high) - F.unix_micros(low)) / F.lit(3_600_000_000)
    return months.groupBy(_month(F.col("_month")).alias("month")).agg(
        F.max(hours).alias("longest_gap_hours")
    )


def slo_report(
    log: DataFrame | None, probes: DataFrame, runs: DataFrame, measured: DataFrame | None = None
) -> DataFrame:
    """Four rows per month: what was promised, what was measured, pass or fail.

    ``measured``, from ``stored_indicators``, takes the place of the log.
    """
    found = (
        (monthly_indicators(log) if measured is None else measured)
        .join(error_budget(probes).select("month", "availability"), "month", "full")
        .join(monthly_freshness(runs), "month", "full")
    )
    checks = [
        ("availability", S.SLO_AVAILABILITY, F.col("availability"), "ge"),
        ("error_rate", S.SLO_ERROR_RATE, F.col("error_rate"), "lt"),
        ("p95_ms", float(S.SLO_P95_MS), F.col("p95_ms"), "lt"),
        ("freshness_hours", float(S.SLO_FRESHNESS_HOURS), F.col("longest_gap_hours"), "le"),
    ]

    def passes(actual: Column, target: float, how: str) -> Column:
        return {"ge": actual >= target, "lt": actual < target, "le": actual <= target}[how]

    rows = F.array(
        *[
            F.struct(
                F.lit(item).alias("item"),
                F.lit(target).alias("target"),
                actual.alias("actual"),
                F.when(actual.isNull(), "no data")
                .when(passes(actual, target, how), "Pass")
                .otherwise("Fail")
                .alias("result"),
            )
            for item, target, actual, how in checks
        ]
    )
    return found.select("month", F.inline(rows))


def update_history(runs: DataFrame, month: str) -> DataFrame:
    """The runs of one month (``yyyy-MM``) and how they ended."""
    kind = F.when(F.col("status") == "rollback", "rollback").otherwise("data update")
    return (
        runs.filter(_month(F.col("run_started_at")) == month)
        .select(
            F.col("run_started_at").alias("at"),
            kind.alias("kind"),
            "data_version",
            "source_url",
            F.when(F.col("status") == "failed", "失敗").otherwise("成功").alias("result"),
        )
        .orderBy("at")
    )


def monthly_compare(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Each month's record count, ratios and p95 next to the calendar month before, null where
    that has none."""
    records = (
        runs.filter(F.col("status").isin("success", "rollback"))
        .groupBy(_month(F.col("created_at")).alias("month"))
        .agg(F.max_by("total_count", F.struct("created_at", "data_version")).alias("record_count"))
    )
    shown = ["record_count", "not_found_ratio", "error_rate", "p95_ms"]
    found = monthly_indicators(log).join(records, "month", "full").select("month", *shown)
    after = F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), 1), "yyyy-MM")
    earlier = found.select(after.alias("month"), *[F.col(c).alias(f"previous_{c}") for c in shown])
    return found.join(earlier, "month", "left").select(
        "month",
        *shown,
        *[f"previous_{c}" for c in shown],
        *[(F.col(c) - F.col(f"previous_{c}")).alias(f"change_{c}") for c in shown],
    )


def incidents(alerted: DataFrame) -> DataFrame:
    """Adjacent alerting windows joined to incidents with a number per month."""
    return numbered(breach_runs(alerted, F.col("level") != "none"))


def numbered(found: DataFrame) -> DataFrame:
    """``found`` incidents with a number per month, in order of their beginning."""
    number = F.row_number().over(
        Window.partitionBy(_month(F.col("started_at"))).orderBy("started_at")
    )
    name = F.format_string("INC-%s-%03d", F.date_format("started_at", "yyyyMM"), number)
    return found.select(name.alias("incident"), "level", "started_at", "ended_at", "windows")


def incident_categories(found: DataFrame, runs: DataFrame, errors: DataFrame) -> DataFrame:
    """``found`` incidents with a ``category``: which of update failure, cache and database had
    failures in one of its 5-minute windows, comma-separated, or ``other``.

    ``errors`` are the dependency errors per 5-minute window.  An incident meets failures by
    window, so neither side is compared as a whole.
    """
    step = F.expr(f"INTERVAL {SLI_MINUTES} MINUTES")
    windows = found.withColumn(
        "window_start", F.explode(F.sequence("started_at", F.col("ended_at") - step, step))
    )
    failed_at = F.window("run_finished_at", SLI_WINDOW)["start"]
    failed = runs.filter("status = 'failed'").select(
        failed_at.alias("window_start"), F.lit("update failure").alias("category")
    )
    names = F.when(F.col("dependency") == "redis", "cache").otherwise("database")
    causes = failed.unionByName(errors.select("window_start", names.alias("category"))).distinct()
    every = F.array_join(F.sort_array(F.collect_set("category")), ",")
    return (
        windows.join(causes, "window_start", "left")
        .groupBy(*found.columns)
        .agg(F.when(every == "", "other").otherwise(every).alias("category"))
    )


def incident_counts(found: DataFrame) -> DataFrame:
    """Incidents per month and level."""
    return found.groupBy(_month(F.col("started_at")).alias("month"), "level").agg(
        F.count(F.lit(1)).alias("incidents")
    )
