"""Report and progress lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.let import filled


def stage_of(stage: Column, fetching: Column, queued_fetch: Column, scoring: Column, queued_score: Column) -> Column:
    """What a run is doing, from its open work."""
    fetch = (fetching > 0) | (queued_fetch > 0)
    score = (scoring > 0) | (queued_score > 0)
    return (
        F.when(stage == "done", F.lit("done"))
        .when(fetch & score, F.lit("mixed"))
        .when(fetch, F.lit("fetching"))
        .when(score, F.lit("scoring"))
        .otherwise(stage)
    )


def start_line(listings: Column) -> Column:
    return F.concat(F.lit("Found "), listings.cast("string"), F.lit(" listings to process"))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label} "), value.cast("string"))


def progress_line(
    stage: Column,
    discovered: Column,
    skipped: Column,
    queued_fetch: Column,
    fetching: Column,
    queued_score: Column,
    scoring: Column,
    matched: Column,
    rejected: Column,
    failed: Column,
    fetch_company: Column,
    score_company: Column,
) -> Column:
    """One line about a running job; the companies are the first active ones, NULL when idle."""
    current = F.concat_ws(
        ", ",
        F.concat(F.lit("fetching "), fetch_company),
        F.concat(F.lit("scoring "), score_company),
    )
    return F.concat_ws(
        " | ",
        F.concat(F.lit("stage: "), stage_of(stage, fetching, queued_fetch, scoring, queued_score)),
        _labelled("discovered", discovered),
        _labelled("skipped", skipped),
        _labelled("queued-fetch", queued_fetch),
        _labelled("fetching", fetching),
        _labelled("queued-score", queued_score),
        _labelled("scoring", scoring),
        _labelled("matched", matched),
        _labelled("rejected", rejected),
        _labelled("failed", failed),
        F.when(current != "", F.concat(F.lit("current: "), current)),
    )


def sync_progress_line(
    processed: Column, total: Column, created: Column, updated: Column, skipped: Column, failed: Column
) -> Column:
    return F.concat_ws(
        " | ",
        F.lit("syncing"),
        F.concat(F.lit("processed "), processed.cast("string"), F.lit("/"), total.cast("string")),
        _labelled("created", created),
        _labelled("updated", updated),
        _labelled("skipped", skipped),
        _labelled("failed", failed),
    )


def done_line(**counters: Column) -> Column:
    parts = [F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in counters.items()]
    return F.concat(F.lit("Done: "), F.concat_ws(" ", *parts))


def match_line(score: Column, title: Column, company: Column, status: Column, salary: Column, url: Column) -> Column:
    return F.concat_ws(
        " | ",
        F.format_string("%.2f", F.coalesce(score, F.lit(0.0))),
        title,
        company,
        F.concat(F.lit("status="), status),
        F.concat(F.lit("salary="), filled(salary)),
        filled(url),
    )


def error_line(row_id: Column, message: Column) -> Column:
    return F.concat(row_id, F.lit(": "), message)
