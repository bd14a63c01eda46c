"""Counters, progress and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import lines
from leadloom.schemas import TOP_MATCHES


def run_summary(outcomes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of run counters.

    ``outcomes`` has one row per listing of the run: ``outcome`` is skipped,
    matched, rejected or failed, and ``fetched`` tells whether its offer text
    was there (also for rows that failed later).  ``stored`` counts the table.
    """

    def n(name: str) -> Column:
        return F.count_if(F.col("outcome") == name).alias(name)

    counters = outcomes.agg(
        F.count(F.lit(1)).alias("scanned"),
        n("skipped"),
        F.count_if(F.col("fetched")).alias("fetched"),
        n("matched"),
        n("rejected"),
        n("failed"),
    )
    if stored is None:
        return counters
    return counters.withColumn("stored", stored.agg(F.count(F.lit(1))).scalar())


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON text, NULL fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def progress_snapshot(
    rows: DataFrame, by: list[str] | None = None, status: str = "status", company: str = "company",
    order: list[str] | None = None,
) -> DataFrame:
    """Counters of a running job and the first company in each active step.

    ``rows`` has one row per listing; statuses as stored, plus ``skipped``,
    ``queued_fetch`` and ``queued_score``.  The companies at work are rows of
    ``active_companies``, not a list in this row, as there is no bound on them.
    """
    s = F.col(status)
    order = order or [company]

    def n(name: str, alias: str | None = None) -> Column:
        return F.count_if(s == name).alias(alias or name)

    def first(name: str) -> Column:
        return F.min_by(F.when(s == name, F.col(company)), F.when(s == name, F.struct(*order)))

    counters = [
        F.count(F.lit(1)).alias("discovered"),
        n("skipped"),
        n("queued_fetch"),
        n("fetching"),
        n("queued_score"),
        n("scoring"),
        n("matched"),
        n("rejected"),
        n("error", "failed"),
        first("fetching").alias("fetch_company"),
        first("scoring").alias("score_company"),
    ]
    grouped = rows.groupBy(*(by or []))
    return grouped.agg(*counters)


def active_companies(rows: DataFrame, status: str = "status", company: str = "company", key: str = "external_id") -> DataFrame:
    """The listings being fetched or scored right now, one row each."""
    return rows.where(F.col(status).isin("fetching", "scoring")).select(
        key, F.col(status).alias("step"), F.col(company).alias("company")
    )


def with_progress_line(snapshot: DataFrame, stage: Column | None = None) -> DataFrame:
    """Add the stage and the progress line of each snapshot row."""
    s = F.lit("discovering") if stage is None else stage
    c = F.col
    line = lines.progress_line(
        s, c("discovered"), c("skipped"), c("queued_fetch"), c("fetching"), c("queued_score"),
        c("scoring"), c("matched"), c("rejected"), c("failed"), c("fetch_company"), c("score_company"),
    )
    name = lines.stage_of(s, c("fetching"), c("queued_fetch"), c("scoring"), c("queued_score"))
    return snapshot.withColumns({"stage": name, "line": line})


def list_jobs(jobs: DataFrame, key: str = "external_id") -> DataFrame:
    """The whole table, latest change first.

    A run stamps all its rows with one time; the key as second sort column lets
    the sort split them over many ranges.
    """
    return jobs.orderBy(F.desc("updated_at"), F.asc(key))


def top_matches(jobs: DataFrame, limit: int = TOP_MATCHES, key: str = "external_id") -> DataFrame:
    """Best matched rows: score, then latest change; the key settles ties."""
    return (
        jobs.where(F.col("status") == "matched")
        .orderBy(F.desc("match_score"), F.desc("updated_at"), F.asc(key))
        .limit(limit)
    )


def report_lines(jobs: DataFrame) -> DataFrame:
    c = F.col
    return jobs.select(
        "external_id",
        lines.match_line(c("match_score"), c("title"), c("company"), c("status"), c("salary_text"), c("url")).alias("line"),
    )


def sync_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of a sync from rows ``external_id, action, error``."""
    ok = F.col("error").isNull()

    def n(action: str, alias: str) -> Column:
        return F.count_if(ok & (F.col("action") == action)).alias(alias)

    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        n("create", "created"),
        n("update", "updated"),
        n("skip", "skipped"),
        F.count_if(~ok).alias("failed"),
    )


def import_summary(decoded: DataFrame) -> DataFrame:
    """Counters of an import; repeated keys each count as imported.

    Rows with an ``error`` failed: a page, or a whole batch, that cannot be read.
    """
    failed = F.col("error").isNotNull() if "error" in decoded.columns else F.lit(False)
    return decoded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("valid") & ~failed).alias("imported"),
        F.count_if(~F.col("valid") & ~failed).alias("skipped"),
        F.count_if(failed).alias("failed"),
    )


def error_rows(outcomes: DataFrame, key: str = "external_id") -> DataFrame:
    """The failed rows as "id: message", one row each."""
    return outcomes.where(F.col("error").isNotNull()).select(
        key, lines.error_line(F.col(key), F.col("error")).alias("error")
    )


class JobFailed(RuntimeError):
    """Some rows of a finished job failed; its results are written.

    ``summary`` has its counters and ``errors`` the failed rows as "id: message".
    """

    def __init__(self, summary: dict, errors: DataFrame | None = None):
        super().__init__(f"{summary['failed']} rows failed")
        self.summary = summary
        self.errors = errors


def fail_if_any(summary: dict, errors: DataFrame | None = None) -> dict:
    """Raise when a finished job's summary counts failures."""
    if summary.get("failed"):
        raise JobFailed(summary, errors)
    return summary
