"""State operators: the prior state is what other tables say about the same keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.tables import table
from leadloom.operators import state as S
from leadloom.session import work_folder
from leadloom.sources.state_table import StateTable

c = F.col
NOW = "2026-01-02T00:00:00.000Z"
OLD = "2026-01-01T00:00:00.000Z"


def customer_status(spark, d):
    """Status of each customer after their latest order."""
    last = S.latest_status(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])
    status = (
        F.when(c("o_orderstatus") == "F", "matched").when(c("o_orderstatus") == "P", "rejected").otherwise("error")
    )
    return last.select(c("o_custkey").alias("c_custkey"), status.alias("status"))


def status_lookup(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return S.status_lookup(rows, customer_status(spark, d), "c_custkey")


def incremental_skip(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return S.incremental_skip(rows, customer_status(spark, d), "c_custkey")


def exists_semi(spark, d):
    return S.known_rows(
        table(spark, d, "part").select("p_partkey", "p_name"),
        table(spark, d, "lineitem").select(c("l_partkey").alias("p_partkey")),
        "p_partkey",
    )


def _listing_columns(key, company, salary, location):
    return [
        F.concat(F.lit("orders:/"), key).alias("external_id"),
        F.lit("orders").alias("source"),
        F.concat(F.lit("https://orders.example.com/"), key).alias("url"),
        F.concat(F.lit("Order "), key).alias("title"),
        company.alias("company"),
        salary.alias("salary_text"),
        location.alias("location"),
    ]


def stored_jobs(spark, d):
    """State rows of the orders that have lines, as their lines tell them."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linestatus").alias("linestatus"),
        F.max("l_returnflag").alias("flag"),
        F.max("l_discount").alias("discount"),
        F.max("l_quantity").alias("quantity"),
    )
    return lines.select(
        *_listing_columns(
            c("l_orderkey"),
            F.lit("line"),
            F.when(c("flag") != "A", F.lit("5-LOW")),
            c("linestatus"),
        ),
        F.when(c("quantity") > 20, F.lit("offer text")).alias("offer_markdown"),
        F.when(c("discount") > 0.05, c("discount")).alias("match_score"),
        F.when(c("discount") > 0.05, F.lit("by discount")).alias("match_reason"),
        F.lit(None).cast("string").alias("summary"),
        F.when(c("discount") > 0.05, F.lit("matched")).otherwise("fetched").alias("status"),
        F.lit(OLD).alias("created_at"),
        F.lit(OLD).alias("updated_at"),
    )


def order_listing():
    """Listing columns of an order; some equal the stored row of its lines."""
    salary = F.when(c("o_orderpriority") == "5-LOW", c("o_orderpriority"))
    return _listing_columns(c("o_orderkey"), F.lit("line"), salary, c("o_orderstatus"))


def sightings(spark, d):
    return table(spark, d, "orders").select(*order_listing())


def upsert_discovered(spark, d):
    return S.upsert_discovered(stored_jobs(spark, d), sightings(spark, d), NOW)


def full_rows(spark, d):
    """Whole job rows of all orders, as an import would bring them."""
    return sightings(spark, d).select(
        "*",
        F.lit(None).cast("string").alias("offer_markdown"),
        F.lit(None).cast("double").alias("match_score"),
        F.lit("imported").alias("match_reason"),
        F.lit("").alias("summary"),
        F.lit("scored").alias("status"),
        F.lit("").alias("created_at"),
        F.lit(NOW).alias("updated_at"),
    )


def upsert_replace(spark, d):
    return S.upsert_replace(stored_jobs(spark, d), full_rows(spark, d))


def updates(spark, d):
    """One update per order by its state: fetched, scored, or only a new status."""
    o = table(spark, d, "orders")
    status = (
        F.when(c("o_orderstatus") == "O", F.lit("fetched"))
        .when(c("o_orderstatus") == "F", F.when(c("o_totalprice") > 250000, F.lit("matched")).otherwise("rejected"))
        .otherwise("error")
    )
    scored = c("o_orderstatus") == "F"
    return o.select(
        F.concat(F.lit("orders:/"), c("o_orderkey")).alias("external_id"),
        F.when(c("o_orderstatus") != "P", F.concat(F.lit("# "), c("o_orderpriority"))).alias("offer_markdown"),
        F.when(scored, c("o_totalprice")).alias("match_score"),
        F.when(scored, F.lit("by price")).alias("match_reason"),
        F.when(scored, c("o_orderpriority")).alias("summary"),
        status.alias("status"),
    )


def apply_updates(spark, d):
    return S.apply_updates(stored_jobs(spark, d), updates(spark, d), NOW)


def latest_status(spark, d):
    return S.latest_status(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


def status_counts(spark, d):
    return latest_status(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def state_scan(spark, d):
    """A table written in full, changed by two change sets, and read back."""
    jobs = StateTable(spark, work_folder(spark, "jobs"))
    empty = jobs.read()
    jobs.append_changes(S.upsert_discovered(empty, stored_jobs(spark, d).select(*S.LISTING_COLUMNS, "external_id"), OLD, how="right_outer"))
    seen = sightings(spark, d)
    jobs.append_changes(S.upsert_discovered(jobs.rows_of(seen), seen, NOW, how="right_outer"))
    jobs.compact()
    jobs.append_changes(S.apply_updates(jobs.read(), updates(spark, d), NOW, how="inner"))
    return jobs.read()


QUERIES = {
    "status_lookup": status_lookup,
    "incremental_skip": incremental_skip,
    "exists_semi": exists_semi,
    "upsert_discovered": upsert_discovered,
    "upsert_replace": upsert_replace,
    "apply_updates": apply_updates,
    "latest_status": latest_status,
    "status_counts": status_counts,
    "state_scan": state_scan,
}

_CUSTOMER_STATUS = """(SELECT o_custkey AS c_custkey, CASE s WHEN 'F' THEN 'matched' WHEN 'P' THEN 'rejected' ELSE 'error' END AS status
  FROM (SELECT o_custkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1)"""

STORED_SQL = f"""
  SELECT 'orders:/' || l_orderkey AS external_id, 'orders' AS source, 'https://orders.example.com/' || l_orderkey AS url,
    'Order ' || l_orderkey AS title, 'line' AS company, CASE WHEN max(l_returnflag) <> 'A' THEN '5-LOW' END AS salary_text,
    max(l_linestatus) AS location, CASE WHEN max(l_quantity) > 20 THEN 'offer text' END AS offer_markdown,
    CASE WHEN max(l_discount) > 0.05::DOUBLE THEN max(l_discount) END AS match_score,
    CASE WHEN max(l_discount) > 0.05::DOUBLE THEN 'by discount' END AS match_reason, CAST(NULL AS VARCHAR) AS summary,
    CASE WHEN max(l_discount) > 0.05::DOUBLE THEN 'matched' ELSE 'fetched' END AS status, '{OLD}' AS created_at, '{OLD}' AS updated_at
  FROM lineitem GROUP BY l_orderkey"""

SEEN_SQL = """
  SELECT 'orders:/' || o_orderkey AS external_id, 'orders' AS source, 'https://orders.example.com/' || o_orderkey AS url,
    'Order ' || o_orderkey AS title, 'line' AS company, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority END AS salary_text,
    o_orderstatus AS location FROM orders"""

UPDATES_SQL = """
  SELECT 'orders:/' || o_orderkey AS external_id, CASE WHEN o_orderstatus <> 'P' THEN '# ' || o_orderpriority END AS offer_markdown,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS match_score, CASE WHEN o_orderstatus = 'F' THEN 'by price' END AS match_reason,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS summary,
    CASE o_orderstatus WHEN 'O' THEN 'fetched' WHEN 'F' THEN CASE WHEN o_totalprice > 250000 THEN 'matched' ELSE 'rejected' END
      ELSE 'error' END AS status FROM orders"""

_CARRIED = ["offer_markdown", "match_score", "match_reason", "summary"]


def upsert_sql(state: str, seen: str, now: str) -> str:
    tracked = ", ".join(f"CASE WHEN n.external_id IS NOT NULL THEN n.{x} ELSE s.{x} END AS {x}" for x in S.LISTING_COLUMNS)
    same = " AND ".join(f"s.{x} IS NOT DISTINCT FROM n.{x}" for x in S.LISTING_COLUMNS)
    carried = ", ".join(f"s.{x}" for x in _CARRIED)
    return f"""SELECT coalesce(s.external_id, n.external_id) AS external_id, {tracked}, {carried},
      CASE WHEN s.external_id IS NULL THEN 'discovered' ELSE s.status END AS status,
      CASE WHEN s.external_id IS NULL THEN '{now}' ELSE s.created_at END AS created_at,
      CASE WHEN s.external_id IS NULL THEN '{now}' WHEN n.external_id IS NULL OR ({same}) THEN s.updated_at ELSE '{now}' END AS updated_at
      FROM ({state}) s FULL JOIN ({seen}) n ON s.external_id = n.external_id"""


def update_sql(state: str, updates_sql: str, now: str) -> str:
    listing = ", ".join(f"s.{x}" for x in S.LISTING_COLUMNS)
    changed = ", ".join(f"coalesce(u.{x}, s.{x}) AS {x}" for x in _CARRIED + ["status"])
    return f"""SELECT s.external_id, {listing}, {changed}, s.created_at,
      CASE WHEN u.external_id IS NOT NULL THEN '{now}' ELSE s.updated_at END AS updated_at
      FROM ({state}) s LEFT JOIN ({updates_sql}) u ON s.external_id = u.external_id"""


_EMPTY_SQL = f"""SELECT external_id, source, url, title, company, salary_text, location, CAST(NULL AS VARCHAR) AS offer_markdown,
  CAST(NULL AS DOUBLE) AS match_score, CAST(NULL AS VARCHAR) AS match_reason, CAST(NULL AS VARCHAR) AS summary,
  'discovered' AS status, '{OLD}' AS created_at, '{OLD}' AS updated_at FROM ({STORED_SQL})"""

ORACLE = {
    "status_lookup": f"SELECT c_custkey, c_name, status FROM customer LEFT JOIN {_CUSTOMER_STATUS} USING (c_custkey)",
    "incremental_skip": f"""
        SELECT c_custkey, c_name FROM customer LEFT JOIN {_CUSTOMER_STATUS} USING (c_custkey)
        WHERE status IS NULL OR status NOT IN ('matched', 'rejected')""",
    "exists_semi": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "upsert_discovered": upsert_sql(STORED_SQL, SEEN_SQL, NOW),
    "upsert_replace": f"""
        SELECT * FROM ({STORED_SQL}) WHERE external_id NOT IN (SELECT 'orders:/' || o_orderkey FROM orders)
        UNION ALL SELECT *, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), 'imported', '', 'scored', '', '{NOW}' FROM ({SEEN_SQL})""",
    "apply_updates": update_sql(STORED_SQL, UPDATES_SQL, NOW),
    "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "status_counts": """
        SELECT event_type, count(*)::BIGINT AS n FROM (
          SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY event_type""",
    "state_scan": update_sql(upsert_sql(_EMPTY_SQL, SEEN_SQL, NOW), UPDATES_SQL, NOW),
}
