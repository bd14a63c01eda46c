"""The tables read as streams and folded into state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings import states
from leadloom.bindings.tables import table
from leadloom.functions import urls as U
from leadloom.session import work_folder
from leadloom.sources.state_table import StateTable
from leadloom.streaming import ingest

c = F.col


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return ingest.file_stream(spark, f"{d.rstrip('/')}/{name}.parquet*", schema)


def _fold(spark, stream, jobs, changes):
    ingest.fold(stream, jobs, changes, work_folder(spark, "checkpoint")).awaitTermination()
    return jobs.read()


def stream_dedupe(spark, d):
    crawled = _stream(spark, d, "pages").select(
        U.external_id(F.lit("web"), c("url")).alias("external_id"), "page_id", "url"
    )
    seen = StateTable(spark, work_folder(spark, "seen"), "external_id string, page_id bigint, url string")
    return _fold(spark, crawled, seen, ingest.first_seen("external_id", ["page_id"]))


def stream_upsert(spark, d):
    """All orders arrive as sightings on top of the rows stored before."""
    jobs = StateTable(spark, work_folder(spark, "jobs"))
    jobs.write_full(states.stored_jobs(spark, d))
    orders = _stream(spark, d, "orders").select(
        *states.order_listing(), c("o_orderkey").alias("pos")
    )
    return _fold(spark, orders, jobs, ingest.upsert_listings(states.NOW))


def stream_status(spark, d):
    schema = "user_id bigint, event_type string, ts timestamp_ntz, event_id bigint"
    jobs = StateTable(spark, work_folder(spark, "status"), schema, "user_id")
    changes = ingest.last_status("user_id", ["ts", "event_id"])
    return _fold(spark, _stream(spark, d, "events"), jobs, changes).select("user_id", "event_type")


QUERIES = {"stream_dedupe": stream_dedupe, "stream_upsert": stream_upsert, "stream_status": stream_status}

ORACLE = {
    "stream_dedupe": """
        SELECT external_id, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (
          SELECT 'web:' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS external_id, page_id, url
          FROM pages) GROUP BY external_id""",
    "stream_upsert": states.ORACLE["upsert_discovered"],
    "stream_status": states.ORACLE["latest_status"],
}
