"""Sync to the external table, import from it, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import external as X
from leadloom.operators import summary as R
from leadloom.operators.progress import Progress, Reporter
from leadloom.schemas import REPORT_SIZE
from leadloom.session import stage
from leadloom.sources.external_pages import Lookup, Sender, send_changes, write_changes
from leadloom.sources.state_table import StateTable


SYNC_COUNTERS = ("total", "created", "updated", "skipped", "failed")


def sync(
    jobs: DataFrame,
    index: DataFrame,
    catalog: DataFrame,
    send: Sender | None = None,
    out: str | None = None,
    parallelism: int | None = None,
    lookup: Lookup | None = None,
    progress: Progress | None = None,
    strict: bool = False,
) -> DataFrame:
    """Bring the external table up to date; returns ``external_id, action, error``.

    Changes go to ``send`` row by row, or to ``out`` as a change-set folder.
    ``strict`` raises ``JobFailed`` once all has been sent if a row failed.
    """
    kinds = X.property_kinds(catalog)
    tell = Reporter(progress, SYNC_COUNTERS)
    # The plan is written once: the sender, the change set and the counters read it.
    planned = X.change_set(X.sync_plan(jobs.drop("offer_markdown"), index), kinds)
    action = F.col("action")
    plan = stage(tell.watch(planned, "planned", total=F.count(F.lit(1)), skipped=F.count_if(action == "skip")), "plan")
    tell.tell("planned")
    no_error = F.lit(None).cast("string").alias("error")
    changes = plan.where(action != "skip")
    if send is None:
        if out:
            write_changes(changes, out)
        return plan.select("external_id", "action", no_error)
    skipped = plan.where(action == "skip").select("external_id", "action", no_error)
    ok = F.col("error").isNull()
    sent = tell.watch(
        send_changes(changes, send, parallelism, lookup), "sent",
        created=F.count_if(ok & (action == "create")), updated=F.count_if(ok & (action == "update")), failed=F.count_if(~ok),
    )
    outcomes = skipped.unionByName(stage(sent, "sent"))
    tell.tell("sent")
    if strict:
        R.fail_if_any(R.sync_summary(outcomes).first().asDict(), R.error_rows(outcomes))
    return outcomes


def import_pages(pages: DataFrame, catalog: DataFrame, table: StateTable, strict: bool = False) -> DataFrame:
    """Replace stored rows by the external pages; returns the one-row summary.

    ``pages`` carry ``batch_no`` and ``pos``; a later page of a key wins.  What
    cannot be read counts as failed and the rest is imported; ``strict`` raises
    ``JobFailed`` after that.
    """
    kinds = X.property_kinds(catalog)
    decoded = stage(
        X.decode_pages(pages, kinds["Status"], kinds.get("Source"), keep=["batch_no", "pos"]), "decoded"
    )
    table.append_changes(X.import_rows(decoded, ["batch_no", "pos"]))
    summary = R.import_summary(decoded)
    if strict and "error" in decoded.columns:
        R.fail_if_any(summary.first().asDict(), import_errors(decoded))
    return summary


def import_errors(decoded: DataFrame) -> DataFrame:
    """The pages and batches that could not be read, as "id: message"."""
    place = F.concat_ws("#", F.element_at(F.split(F.col("batch_no").cast("string"), "/"), -1), "pos")
    failed = decoded.select(F.coalesce("page_id", place).alias("external_id"), "error")
    return R.error_rows(failed)


def report(jobs: DataFrame, limit: int = REPORT_SIZE) -> list[str]:
    """Lines about the best matches; the limit bounds what reaches the driver."""
    rows = R.report_lines(R.top_matches(jobs, limit)).collect()
    return [r["line"] for r in rows] or ["No matched jobs stored yet."]

