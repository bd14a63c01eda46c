"""Counters, progress lines and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.tables import table
from leadloom.functions import lines
from leadloom.operators import summary as R

c = F.col


def _outcomes(spark, d):
    """Each order is a listing: urgent ones were done before, the state tells the others."""
    urgent = c("o_orderpriority") == "1-URGENT"
    outcome = (
        F.when(urgent, "skipped")
        .when(c("o_orderstatus") == "F", "matched")
        .when(c("o_orderstatus") == "O", "rejected")
        .otherwise("failed")
    )
    fetched = ~urgent & ((c("o_orderstatus") != "P") | (c("o_orderpriority") == "5-LOW"))
    return table(spark, d, "orders").select("o_orderkey", outcome.alias("outcome"), fetched.alias("fetched"))


def run_summary(spark, d):
    return R.run_summary(_outcomes(spark, d), table(spark, d, "lineitem"))


def run_summary_json(spark, d):
    return R.as_json(run_summary(spark, d))


def done_line(spark, d):
    names = ["scanned", "skipped", "fetched", "matched", "rejected", "failed"]
    s = run_summary(spark, d)
    return s.select(
        lines.done_line(**{n: c(n) for n in names}, **{"local-db-total": c("stored")}).alias("line"),
        lines.start_line(c("scanned")).alias("start"),
    )


def _work(spark, d):
    """Each event is a listing in some step; the user is the company."""
    status = (
        F.when(c("event_type") == "click", "fetching")
        .when(c("event_type") == "view", "scoring")
        .when(c("event_type") == "signup", F.when(c("value") > 20, "queued_fetch").otherwise("queued_score"))
        .when(c("event_type") == "purchase", F.when(c("value") > 10, "matched").otherwise("rejected"))
        .otherwise(F.when(c("value") > 30, "skipped").otherwise("error"))
    )
    return table(spark, d, "events").select(
        c("event_id").alias("external_id"), "user_id", status.alias("status"),
        F.concat(F.lit("Company "), F.lpad(c("event_id").cast("string"), 12, "0")).alias("company"),
    )


def progress_snapshot(spark, d):
    return R.progress_snapshot(_work(spark, d), order=["external_id"])


def progress_line(spark, d):
    """One snapshot and its line per user."""
    snapshot = R.progress_snapshot(_work(spark, d), by=["user_id"], order=["external_id"])
    return R.with_progress_line(snapshot).select("user_id", "stage", "line")


def derive_stage(spark, d):
    """Stage from the line counts of each order."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if((c("l_returnflag") == "A") & (c("l_linestatus") == "F")).alias("fetching"),
        F.count_if((c("l_returnflag") == "A") & (c("l_linestatus") == "O")).alias("queued_fetch"),
        F.count_if((c("l_returnflag") == "R") & (c("l_linestatus") == "F")).alias("scoring"),
        F.count_if((c("l_returnflag") == "R") & (c("l_linestatus") == "O")).alias("queued_score"),
        F.min("l_linestatus").alias("low"),
        F.max("l_discount").alias("top"),
    )
    own = F.when(c("top") > 0.09, "done").when(c("low") == "F", "discovering").otherwise("fetching")
    return o.select(
        "l_orderkey",
        lines.stage_of(own, c("fetching"), c("queued_fetch"), c("scoring"), c("queued_score")).alias("stage"),
    )


def active_companies(spark, d):
    return R.active_companies(_work(spark, d))


def _jobs(spark, d):
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("external_id"),
        F.concat(F.lit("Order "), c("o_orderkey")).alias("title"),
        F.concat(F.lit("Customer "), c("o_custkey")).alias("company"),
        F.when(c("o_orderstatus") == "F", "matched").when(c("o_orderstatus") == "O", "rejected").otherwise("error").alias("status"),
        F.when(c("o_totalprice") > 1000, c("o_totalprice") / 1000000).alias("match_score"),
        F.when(c("o_orderpriority") != "5-LOW", F.regexp_replace("o_orderpriority", "4-NOT SPECIFIED", "")).alias("salary_text"),
        F.concat(F.lit("https://orders.example.com/"), c("o_orderkey")).alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
    )


def report_topk(spark, d):
    return R.top_matches(_jobs(spark, d), 10).select("external_id", "match_score", "updated_at")


def report_lines(spark, d):
    """A line for every job; scores are cut to two decimals first, so none is a rounding tie."""
    return R.report_lines(_jobs(spark, d).withColumn("match_score", F.floor(c("match_score") * 100) / 100))


def list_jobs(spark, d):
    return R.list_jobs(_jobs(spark, d))


QUERIES = {
    "run_summary": run_summary,
    "run_summary_json": run_summary_json,
    "done_line": done_line,
    "progress_snapshot": progress_snapshot,
    "progress_line": progress_line,
    "derive_stage": derive_stage,
    "active_companies": active_companies,
    "report_topk": report_topk,
    "report_lines": report_lines,
    "list_jobs": list_jobs,
}

_SUMMARY = """(SELECT count(*)::BIGINT AS scanned, n('skipped') AS skipped,
    count(*) FILTER (WHERE NOT urgent AND (o_orderstatus <> 'P' OR o_orderpriority = '5-LOW'))::BIGINT AS fetched,
    n('matched') AS matched, n('rejected') AS rejected, n('failed') AS failed,
    (SELECT count(*) FROM lineitem)::BIGINT AS stored
  FROM (SELECT *, CASE WHEN urgent THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'matched' WHEN o_orderstatus = 'O' THEN 'rejected' ELSE 'failed' END AS outcome
    FROM (SELECT *, o_orderpriority = '1-URGENT' AS urgent FROM orders)))"""
for _name in ("skipped", "matched", "rejected", "failed"):
    _SUMMARY = _SUMMARY.replace(f"n('{_name}')", f"count(*) FILTER (WHERE outcome = '{_name}')::BIGINT")

_WORK = """(SELECT event_id AS external_id, user_id, 'Company ' || lpad(event_id::VARCHAR, 12, '0') AS company, CASE event_type
    WHEN 'click' THEN 'fetching' WHEN 'view' THEN 'scoring'
    WHEN 'signup' THEN CASE WHEN value > 20 THEN 'queued_fetch' ELSE 'queued_score' END
    WHEN 'purchase' THEN CASE WHEN value > 10 THEN 'matched' ELSE 'rejected' END
    ELSE CASE WHEN value > 30 THEN 'skipped' ELSE 'error' END END AS status FROM events)"""
_STATUSES = ["skipped", "queued_fetch", "fetching", "queued_score", "scoring", "matched", "rejected"]
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}')::BIGINT AS {s}" for s in _STATUSES)
_SNAPSHOT = f"""count(*)::BIGINT AS discovered, {_COUNTS}, count(*) FILTER (WHERE status = 'error')::BIGINT AS failed,
    arg_min(company, external_id) FILTER (WHERE status = 'fetching') AS fetch_company,
    arg_min(company, external_id) FILTER (WHERE status = 'scoring') AS score_company"""

_JOBS = """(SELECT o_orderkey AS external_id, 'Order ' || o_orderkey AS title, 'Customer ' || o_custkey AS company,
    CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'rejected' ELSE 'error' END AS status,
    CASE WHEN o_totalprice > 1000 THEN o_totalprice / 1000000 END AS match_score,
    CASE WHEN o_orderpriority <> '5-LOW' THEN replace(o_orderpriority, '4-NOT SPECIFIED', '') END AS salary_text,
    'https://orders.example.com/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders)"""

ORACLE = {
    "run_summary": f"SELECT * FROM {_SUMMARY}",
    "run_summary_json": f"""
        SELECT '{{"scanned":' || scanned || ',"skipped":' || skipped || ',"fetched":' || fetched || ',"matched":' || matched
          || ',"rejected":' || rejected || ',"failed":' || failed || ',"stored":' || stored || '}}' AS json FROM {_SUMMARY}""",
    "done_line": f"""
        SELECT 'Done: scanned=' || scanned || ' skipped=' || skipped || ' fetched=' || fetched || ' matched=' || matched || ' rejected='
          || rejected || ' failed=' || failed || ' local-db-total=' || stored AS line,
          'Found ' || scanned || ' listings to process' AS start FROM {_SUMMARY}""",
    "progress_snapshot": f"SELECT {_SNAPSHOT} FROM {_WORK}",
    "progress_line": f"""
        SELECT user_id, stage, 'stage: ' || stage || ' | discovered ' || discovered || ' | skipped ' || skipped || ' | queued-fetch '
          || queued_fetch || ' | fetching ' || fetching || ' | queued-score ' || queued_score || ' | scoring ' || scoring || ' | matched '
          || matched || ' | rejected ' || rejected || ' | failed ' || failed
          || CASE WHEN fetching + scoring > 0 THEN ' | current: ' ELSE '' END
          || CASE WHEN fetching > 0 THEN 'fetching ' || fetch_company ELSE '' END
          || CASE WHEN fetching > 0 AND scoring > 0 THEN ', ' ELSE '' END
          || CASE WHEN scoring > 0 THEN 'scoring ' || score_company ELSE '' END AS line
        FROM (SELECT *, CASE WHEN fetching + queued_fetch > 0 THEN CASE WHEN scoring + queued_score > 0 THEN 'mixed' ELSE 'fetching' END
            WHEN scoring + queued_score > 0 THEN 'scoring' ELSE 'discovering' END AS stage
          FROM (SELECT user_id, {_SNAPSHOT} FROM {_WORK} GROUP BY user_id))""",
    "derive_stage": """
        SELECT l_orderkey, CASE WHEN top > 0.09::DOUBLE THEN 'done' WHEN f > 0 AND s > 0 THEN 'mixed' WHEN f > 0 THEN 'fetching'
            WHEN s > 0 THEN 'scoring' WHEN low = 'F' THEN 'discovering' ELSE 'fetching' END AS stage
        FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS f, count(*) FILTER (WHERE l_returnflag = 'R') AS s,
            min(l_linestatus) AS low, max(l_discount) AS top FROM lineitem GROUP BY l_orderkey)""",
    "active_companies": f"""
        SELECT external_id, status AS step, company FROM {_WORK} WHERE status IN ('fetching', 'scoring')""",
    "report_topk": f"""
        SELECT external_id, match_score, updated_at FROM {_JOBS} WHERE status = 'matched'
        ORDER BY match_score DESC NULLS LAST, updated_at DESC, external_id LIMIT 10""",
    "report_lines": f"""
        SELECT external_id, printf('%.2f', coalesce(floor(match_score * 100) / 100, 0.0)) || ' | ' || title || ' | ' || company || ' | status=' || status
          || coalesce(' | salary=' || nullif(salary_text, ''), '') || ' | ' || url AS line FROM {_JOBS}""",
    "list_jobs": f"SELECT * FROM {_JOBS}",
}
