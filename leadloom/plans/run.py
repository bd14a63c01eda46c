"""A run: discover, store, skip, join offers, score, classify, store, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import state as S
from leadloom.operators.scoring import Scorer, score_offers
from leadloom.operators.progress import Progress, Reporter
from leadloom.operators.summary import run_summary
from leadloom.plans.discover import discover
from leadloom.schemas import RunConfig
from leadloom.session import stage
from leadloom.sources.boards import BOARDS, Board
from leadloom.sources.pages import offer_join
from leadloom.sources.state_table import StateTable

ScorerFactory = Callable[[DataFrame], Scorer]


def process_listings(
    listings: DataFrame,
    table: StateTable,
    offers: DataFrame,
    load_profile: Callable[[], DataFrame],
    make_scorer: ScorerFactory,
    threshold: float,
    now: str,
    tag: str | None = None,
    progress: Progress | None = None,
) -> DataFrame:
    """Store the sightings, process the open ones, store their outcomes.

    ``listings`` is unique by key and is read several times, so it should be a
    written table.  Returns the run's rows: ``external_id, outcome, fetched,
    error``.  The profile is read only if some listing is open; when that
    fails, the sightings are stored already and stay ``discovered``.
    """
    report = Reporter(progress)
    known = table.rows_of(listings)
    looked_up = S.status_lookup(listings.select("external_id"), known)
    waiting = S.needs_work(F.col("status"))
    looked_up = report.watch(
        looked_up, "discovered", discovered=F.count(F.lit(1)), skipped=F.count_if(~waiting), queued_fetch=F.count_if(waiting)
    )
    before = stage(looked_up, "statuses")
    report.tell("discovered")
    sightings = S.upsert_discovered(known, listings, now, how="right_outer")
    table.append_changes(sightings, tag and f"{tag}-seen")

    open_keys = before.where(S.needs_work(F.col("status"))).select("external_id")
    skipped = before.where(~S.needs_work(F.col("status"))).select(
        "external_id",
        F.lit("skipped").alias("outcome"),
        F.lit(False).alias("fetched"),
        F.lit(None).cast("string").alias("error"),
    )
    if open_keys.isEmpty():
        return skipped
    scorer = make_scorer(load_profile())
    work = listings.join(open_keys, "external_id", "left_semi").select("external_id", "url")
    failed = F.col("error").isNotNull()
    fetched = report.watch(
        offer_join(work, offers), "fetched", queued_fetch=-F.count(F.lit(1)), queued_score=F.count_if(~failed), failed=F.count_if(failed)
    )
    decided = F.col("status")
    scored = report.watch(
        score_offers(fetched, scorer, threshold), "scored",
        queued_score=-F.count_if("fetched"),
        matched=F.count_if(decided == "matched"),
        rejected=F.count_if(decided == "rejected"),
        failed=F.count_if((decided == "error") & F.col("fetched")),
    )
    outcomes = stage(scored, "outcomes")
    report.tell("fetched")
    report.tell("scored")
    updates = outcomes.drop("error", "fetched")
    table.append_changes(
        S.apply_updates(table.rows_of(updates), updates, now, how="inner"), tag and f"{tag}-done"
    )
    processed = outcomes.select(
        "external_id",
        F.when(F.col("status") == "error", F.lit("failed")).otherwise(F.col("status")).alias("outcome"),
        "fetched",
        "error",
    )
    return skipped.unionByName(processed)


def run(
    config: RunConfig,
    pages: DataFrame,
    offers: DataFrame,
    table: StateTable,
    load_profile: Callable[[], DataFrame],
    make_scorer: ScorerFactory,
    now: str,
    source: str | None = None,
    strict: bool = True,
    boards: dict[str, Board] = BOARDS,
    progress: Progress | None = None,
) -> DataFrame:
    """One crawl run; returns its one-row summary.

    ``progress`` is told the counters after each step, and the summary at the end.
    """
    listings = stage(discover(pages, config, source, strict, boards), "found")
    outcomes = process_listings(
        listings, table, offers, load_profile, make_scorer, config.match_threshold, now, progress=progress
    )
    summary = run_summary(outcomes, table.read())
    if progress:
        progress("done", summary.first().asDict())
    return summary
