"""Whole runs: landed pages of three boards, stored rows, offers, a profile, a scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.discovery import FLAT_LISTINGS, built_pages, crawl_config, landed_pages
from leadloom.bindings.tables import table
from leadloom.operators.scoring import lexical_scorer
from leadloom.plans.crawl import check_crawl, crawl_table
from leadloom.plans.run import run
from leadloom.schemas import JOB_COLUMNS, PAGES
from leadloom.session import work_folder
from leadloom.sources.pages import read_profile
from leadloom.sources.state_table import StateTable
from leadloom.streaming.ingest import file_stream, run_stream

c = F.col
NOW = "2026-01-02T00:00:00.000Z"
OLD = "2026-01-01T00:00:00.000Z"


def _order_path():
    return F.concat(
        F.lit("/companies/jobs/"), c("o_orderkey"), F.lit("-"), F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("%20"))
    )


def stored(spark, d):
    """Finished and failed orders were stored by an earlier run, with an older title."""
    o = table(spark, d, "orders").where(c("o_orderstatus") != "O")
    none = F.lit(None).cast("string")
    rows = o.select(
        F.concat(F.lit("bulldogjob:"), _order_path()).alias("external_id"),
        F.lit("bulldogjob").alias("source"),
        F.concat(F.lit("https://bulldogjob.com"), _order_path()).alias("url"),
        F.concat(F.lit("Order "), F.when(c("o_orderpriority") == "5-LOW", "5-lower").otherwise(c("o_orderpriority"))).alias("title"),
        F.concat(F.when(c("o_orderstatus") == "F", "Logo ").otherwise("Customer "), c("o_custkey")).alias("company"),
        none.alias("salary_text"),
        c("o_orderstatus").alias("location"),
        none.alias("offer_markdown"),
        F.when(c("o_orderstatus") == "F", F.lit(0.9)).alias("match_score"),
        F.lit("earlier").alias("match_reason"),
        none.alias("summary"),
        F.when(c("o_orderstatus") == "F", "matched").otherwise("error").alias("status"),
        F.lit(OLD).alias("created_at"),
        F.lit(OLD).alias("updated_at"),
    )
    return rows.select(JOB_COLUMNS)


def offers(spark, d):
    """Texts of all parts and most orders; fetching large parts failed, and no customer's offer was landed."""
    failed = c("p_size") > 45
    parts = table(spark, d, "part").select(
        F.concat(F.lit("http://nofluffjobs.com/pl/job/part-"), c("p_partkey")).alias("url"),
        F.when(~failed, F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("offer_markdown"),
        F.when(failed, F.lit("timeout")).alias("error"),
    )
    orders = table(spark, d, "orders").where(c("o_orderpriority") != "5-LOW").select(
        F.concat(F.lit("https://bulldogjob.com"), _order_path()).alias("url"),
        F.concat_ws(" ", F.lit("order"), "o_orderpriority", "o_orderstatus").alias("offer_markdown"),
        F.lit(None).cast("string").alias("error"),
    )
    return parts.unionByName(orders)


def profile(spark, d):
    """The profile is what the first part is like."""
    first = table(spark, d, "part").where(c("p_partkey") == 0)
    return first.select(F.concat_ws(" ", "p_name", "p_type").alias("profile"))


def _stored(spark, d):
    jobs = StateTable(spark, work_folder(spark, "jobs"))
    jobs.write_full(stored(spark, d))
    return jobs


def _profile(spark, d):
    """The profile as a landed document, read only when a listing is open."""
    folder = work_folder(spark, "profile")
    profile(spark, d).coalesce(1).write.text(folder)
    return lambda: read_profile(spark, folder)


def _run(spark, d):
    jobs = _stored(spark, d)
    landed = landed_pages(spark, d)
    summary = run(crawl_config(), landed, offers(spark, d), jobs, _profile(spark, d), lexical_scorer, NOW)
    return jobs, summary


def crawl_run(spark, d):
    return _run(spark, d)[1]


def crawl_state(spark, d):
    return _state(_run(spark, d)[0])


#: Files in which the pages of a streamed crawl land, one a micro-batch.
PIECES = 3


def stream_run(spark, d):
    """The pages land in pieces, whatever page in whatever piece; one run a piece."""
    folder, config = work_folder(spark, "landed"), crawl_config()
    piece = F.pmod(F.xxhash64("url"), F.lit(PIECES))
    pages = built_pages(spark, d).withColumn("landed_at", F.lit(None).cast("string"))
    pages.repartitionByRange(PIECES, piece).write.parquet(folder)
    jobs, crawl = _stored(spark, d), crawl_table(spark, work_folder(spark, "crawl"))
    stream = file_stream(spark, folder, PAGES, files_per_batch=1)
    texts = offers(spark, d)
    run_stream(
        stream, config, crawl, jobs, lambda: texts, _profile(spark, d), lexical_scorer, lambda: NOW, work_folder(spark, "checkpoint")
    ).awaitTermination()
    check_crawl(crawl, config)
    return _state(jobs)


def _state(jobs):
    return jobs.read().select(
        "external_id", "title", "company", "salary_text", "location", "offer_markdown",
        F.round("match_score", 6).alias("match_score"), "status", "created_at", "updated_at",
    )


QUERIES = {"crawl_run": crawl_run, "crawl_state": crawl_state, "stream_run": stream_run}

_ORDER_PATH = "'/companies/jobs/' || o_orderkey || '-' || replace(lower(o_orderpriority), ' ', '%20')"
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
_MINE = f"(SELECT {_WORDS.format('''p_name || ' ' || p_type''')} FROM part WHERE p_partkey = 0)"


def _share(text: str) -> str:
    return f"(len(list_intersect({_WORDS.format(text)}, {_MINE})) / len({_MINE}))"


_PART_TEXT = "p_name || ' ' || p_type || ' ' || p_brand"
_ORDER_TEXT = "'order ' || o_orderpriority || ' ' || o_orderstatus"

# One row per listing with its outcome and the row stored in the end.
_RESULT = f"""(
  SELECT external_id, title, company, salary_text, location, CAST(NULL AS VARCHAR) AS offer_markdown, CAST(NULL AS DOUBLE) AS match_score,
    'error' AS status, '{NOW}' AS created_at, '{NOW}' AS updated_at, false AS fetched, false AS skipped FROM ({FLAT_LISTINGS})
  UNION ALL
  SELECT 'nofluffjobs:/pl/job/part-' || p_partkey AS external_id, p_name AS title, p_brand AS company,
    floor(p_retailprice)::BIGINT || ' - ' || (floor(p_retailprice)::BIGINT + 100) || ' PLN' AS salary_text, p_type AS location,
    CASE WHEN p_size <= 45 THEN {_PART_TEXT} END AS offer_markdown, CASE WHEN p_size <= 45 THEN round(share, 6) END AS match_score,
    CASE WHEN p_size > 45 THEN 'error' WHEN share >= 0.4::DOUBLE THEN 'matched' ELSE 'rejected' END AS status,
    '{NOW}' AS created_at, '{NOW}' AS updated_at, p_size <= 45 AS fetched, false AS skipped
  FROM (SELECT *, {_share(_PART_TEXT)} AS share FROM part)
  UNION ALL
  SELECT 'bulldogjob:' || {_ORDER_PATH}, 'Order ' || o_orderpriority,
    CASE WHEN o_orderstatus = 'F' THEN 'Logo ' ELSE 'Customer ' END || o_custkey, CAST(NULL AS VARCHAR), o_orderstatus,
    CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' THEN {_ORDER_TEXT} END,
    CASE WHEN o_orderstatus = 'F' THEN 0.9::DOUBLE WHEN o_orderpriority <> '5-LOW' THEN round(share, 6) END,
    CASE WHEN o_orderstatus = 'F' THEN 'matched' WHEN o_orderpriority = '5-LOW' THEN 'error'
      WHEN share >= 0.4::DOUBLE THEN 'matched' ELSE 'rejected' END,
    CASE WHEN o_orderstatus = 'O' THEN '{NOW}' ELSE '{OLD}' END,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN '{OLD}' ELSE '{NOW}' END,
    o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW', o_orderstatus = 'F'
  FROM (SELECT *, {_share(_ORDER_TEXT)} AS share FROM orders))"""

ORACLE = {
    "crawl_run": f"""
        SELECT count(*)::BIGINT AS scanned, count(*) FILTER (WHERE skipped)::BIGINT AS skipped,
          count(*) FILTER (WHERE fetched)::BIGINT AS fetched,
          count(*) FILTER (WHERE NOT skipped AND status = 'matched')::BIGINT AS matched,
          count(*) FILTER (WHERE NOT skipped AND status = 'rejected')::BIGINT AS rejected,
          count(*) FILTER (WHERE NOT skipped AND status = 'error')::BIGINT AS failed, count(*)::BIGINT AS stored FROM {_RESULT}""",
    "crawl_state": f"""
        SELECT external_id, title, company, salary_text, location, offer_markdown, match_score, status, created_at, updated_at
        FROM {_RESULT}""",
}
ORACLE["stream_run"] = ORACLE["crawl_state"]
