"""The external table: pages built from orders, decoded, compared and rebuilt."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.states import STORED_SQL, stored_jobs
from leadloom.bindings.tables import table
from leadloom.functions import lines
from leadloom.operators import external as X
from leadloom.operators import summary as R
from leadloom.plans.exchange import import_errors, import_pages, sync
from leadloom.schemas import PAGE_BATCH
from leadloom.session import work_folder
from leadloom.sources.external_pages import explode_batches, read_page_batches
from leadloom.sources.state_table import StateTable

c = F.col

# Pages per landed batch.
BATCH = 100


def _quoted(value):
    return F.concat(F.lit('"'), value, F.lit('"'))


def page_json(spark, d):
    """One external page per order as JSON text, some of them broken.

    Low-priority orders have no status; open orders name no source, and their
    id carries it; large scores are texts and so not readable as numbers.
    """
    o = table(spark, d, "orders")
    key = c("o_orderkey").cast("string")
    prefix = F.when(c("o_orderstatus") == "P", "unknown").otherwise("justjoinit")
    text = lambda v: F.concat(F.lit('{"type":"rich_text","rich_text":[{"plain_text":'), _quoted(v), F.lit("}]}"))
    properties = F.concat_ws(
        ",",
        F.concat(F.lit('"Name":{"type":"title","title":[{"plain_text":"Order "},{"plain_text":'), _quoted(key), F.lit("}]}")),
        F.concat(F.lit('"External ID":'), text(F.concat(prefix, F.lit(":/"), key))),
        F.concat(F.lit('"URL":{"type":"url","url":'), _quoted(F.concat(F.lit("https://orders.example.com/"), key)), F.lit("}")),
        F.when(
            c("o_orderpriority") != "5-LOW",
            F.concat(F.lit('"Status":{"type":"status","status":{"name":'), _quoted(F.when(c("o_orderpriority") == "1-URGENT", "matched").otherwise("fetched")), F.lit("}}")),
        ),
        F.when(c("o_orderstatus") != "O", F.lit('"Source":{"type":"select","select":{"name":"bulldogjob"}}')),
        F.when(c("o_orderpriority") == "2-HIGH", F.concat(F.lit('"Company":'), text(F.concat(F.lit("Customer "), c("o_custkey"))))),
        F.when(
            c("o_totalprice") < 400000,
            F.concat(F.lit('"Match Score":{"type":"number","number":'), c("o_totalprice").cast("string"), F.lit("}")),
        ).otherwise(F.concat(F.lit('"Match Score":{"type":"number","number":'), _quoted(c("o_totalprice").cast("string")), F.lit("}"))),
        F.when(
            c("o_orderpriority") == "1-URGENT",
            F.concat(F.lit('"Updated At":{"type":"date","date":{"start":'), _quoted(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("}}")),
        ).when(c("o_orderpriority") == "2-HIGH", F.lit('"Updated At":{"type":"rich_text","rich_text":[]}')),
    )
    times = F.when(c("o_orderstatus") != "F", F.lit(',"created_time":"2024-01-01T00:00:00.000Z","last_edited_time":"2024-01-03T00:00:00.000Z"')).otherwise("")
    page = F.concat(F.lit('{"id":'), _quoted(F.concat(F.lit("page-"), key)), times, F.lit(',"properties":{'), properties, F.lit("}}"))
    return o.select("o_orderkey", page.alias("page"))


def external_pages(spark, d):
    """The pages as landed in batches, decoded by the fixed schema."""
    batch_no = F.floor(c("o_orderkey") / BATCH)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "page"))), lambda x: x["page"])
    batches = page_json(spark, d).groupBy(batch_no.alias("batch_no")).agg(
        F.concat(F.lit('{"results":['), F.array_join(ordered, ","), F.lit('],"has_more":true}')).alias("json")
    )
    decoded = batches.select("batch_no", F.from_json("json", PAGE_BATCH).alias("b"))
    return explode_batches(decoded.select("batch_no", "b.results"), "batch_no")


def schema_check(spark, d):
    """Violations in the catalog the pages themselves show."""
    seen = X.page_catalog(external_pages(spark, d))
    renamed = F.when(c("name") == "Company", "Salary").when(c("name") == "URL", "Address").otherwise(c("name"))
    changed = F.when(c("name") == "Company", "number").when(c("name") == "Match Score", c("type")).otherwise(c("type"))
    catalog = seen.select(renamed.alias("name"), changed.alias("type")).where((c("name") != "Updated At") | (c("type") != "date"))
    return X.catalog_violations(catalog)


def page_catalog(spark, d):
    return X.page_catalog(external_pages(spark, d))


def _decoded(spark, d):
    return X.decode_pages(external_pages(spark, d).drop("error"), "status", "select", keep=["batch_no", "pos"])


def import_decode(spark, d):
    return _decoded(spark, d).drop("batch_no", "pos")


def import_rows(spark, d):
    """Rows of an import in which two pages may name the same job."""
    decoded = _decoded(spark, d)
    shared = F.concat(c("source"), F.lit(":/"), c("company"), F.lit("/"), c("status"))
    merged = decoded.withColumn("external_id", F.when(c("company") != "", shared).otherwise(c("external_id")))
    return X.import_rows(merged, ["batch_no", "pos"]).select("external_id", "url", "status", "match_score", "updated_at")


#: Orders in a landed batch file, and which of the files were cut off.
FILE, CUT_OFF = 1000, 3


def _landed(spark, d):
    """The pages as batch files, some of which were cut off when they landed."""
    no = F.floor(c("o_orderkey") / FILE)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "page"))), lambda x: x["page"])
    whole = F.concat(F.lit('{"results":['), F.array_join(ordered, ","), F.lit("]}"))
    files = page_json(spark, d).groupBy(no.alias("no")).agg(whole.alias("value"))
    cut = F.when(F.pmod("no", F.lit(7)) == CUT_OFF, F.left("value", F.length("value") - 20)).otherwise(c("value"))
    folder = work_folder(spark, "batches")
    files.select(F.lpad(c("no").cast("string"), 9, "0").alias("batch"), cut.alias("value")).write.partitionBy("batch").text(folder)
    return read_page_batches(spark, folder)


def _imported(spark, d):
    jobs = StateTable(spark, work_folder(spark, "jobs"))
    catalog = spark.createDataFrame([*KINDS.items(), ("Company", "rich_text")], "name string, type string")
    return import_pages(_landed(spark, d), catalog, jobs), jobs


def import_summary(spark, d):
    return _imported(spark, d)[0]


def import_state(spark, d):
    """The rows stored by an import."""
    return _imported(spark, d)[1].read().select("external_id", "source", "url", "title", "company", "match_score", "status", "updated_at")


def import_failures(spark, d):
    """The batch files that could not be read."""
    decoded = X.decode_pages(_landed(spark, d), "status", "select", keep=["batch_no", "pos"])
    return import_errors(decoded).select(F.regexp_replace("error", ".*: ", "").alias("error"), F.col("external_id").endswith("#0").alias("whole"))


KINDS = {
    "Name": "title", "External ID": "rich_text", "URL": "url", "Status": "status", "Source": "select",
    "Salary": "rich_text", "Location": "rich_text", "Match Score": "number", "Summary": "rich_text",
    "Created At": "date", "Updated At": "rich_text",
}


def build_properties(spark, d):
    return stored_jobs(spark, d).select("external_id", X.build_properties(KINDS).alias("properties_json"))


def _index(spark, d):
    """Pages of the orders' jobs, each listed once per line; the first page counts.

    Returned lines were synced at the stored version, others before it.
    """
    o = table(spark, d, "orders").join(
        table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_partkey"), "o_orderkey"
    )
    pages = o.where(c("o_orderstatus") != "P").select(
        F.concat(F.lit("orders:/"), c("o_orderkey")).alias("external_id"),
        F.concat_ws("-", F.lit("page"), c("o_orderkey"), c("l_linenumber"), c("l_partkey")).alias("page_id"),
        F.when(c("l_returnflag") == "A", F.lit(None).cast("string")).when(c("l_returnflag") == "R", F.lit("2026-01-01T00:00:00.000Z")).otherwise("stale").alias("synced_updated_at"),
        "l_linenumber", "l_partkey",
    )
    return X.dedupe_first(pages, ["external_id"], ["l_linenumber", "l_partkey", "page_id", "synced_updated_at"])


def _plan(spark, d):
    return X.sync_plan(stored_jobs(spark, d), _index(spark, d))


def sync_plan(spark, d):
    return _plan(spark, d).select("external_id", "page_id", "action")


def external_index(spark, d):
    """The index as read from the pages' own properties."""
    return X.external_index(external_pages(spark, d), ["batch_no", "pos"])


def _catalog(spark):
    return spark.createDataFrame(list(KINDS.items()), "name string, type string")


def sync_changeset(spark, d):
    """The change set as a sync writes it for a sender, read back."""
    path = work_folder(spark, "changes")
    sync(stored_jobs(spark, d), _index(spark, d), _catalog(spark), out=path)
    schema = "page_id string, external_id string, properties_json string, action string"
    return spark.read.schema(schema).json(path).select("action", "page_id", "external_id", F.md5("properties_json").alias("digest"))


def _sent(spark, d):
    """Send every change; the target refuses updates of rows without a score."""

    def send(action, page_id, properties, key):
        if action == "update" and '"number":null' in properties:
            raise ValueError("validation failed")

    return sync(stored_jobs(spark, d), _index(spark, d), _catalog(spark), send)


def sync_summary(spark, d):
    return R.sync_summary(_sent(spark, d))


def sync_line(spark, d):
    s = sync_summary(spark, d)
    return s.select(
        lines.sync_progress_line(c("total"), c("total"), c("created"), c("updated"), c("skipped"), c("failed")).alias("line")
    )


def sync_errors(spark, d):
    return R.error_rows(_sent(spark, d))


QUERIES = {
    "schema_check": schema_check,
    "page_catalog": page_catalog,
    "import_decode": import_decode,
    "import_rows": import_rows,
    "import_summary": import_summary,
    "import_state": import_state,
    "import_failures": import_failures,
    "build_properties": build_properties,
    "external_index": external_index,
    "sync_plan": sync_plan,
    "sync_changeset": sync_changeset,
    "sync_summary": sync_summary,
    "sync_line": sync_line,
    "sync_errors": sync_errors,
}

_PAGES = """(SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'justjoinit' END || ':/' || o_orderkey AS external_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderpriority = '2-HIGH' THEN '' END AS synced,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE '2024-01-01T00:00:00.000Z' END AS created,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE '2024-01-03T00:00:00.000Z' END AS edited FROM orders)"""

_DECODED = f"""(SELECT 'page-' || o_orderkey AS page_id, external_id,
    CASE WHEN o_orderstatus = 'O' THEN 'justjoinit' ELSE 'bulldogjob' END AS source,
    'https://orders.example.com/' || o_orderkey AS url, 'Order ' || o_orderkey AS title,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'Customer ' || o_custkey ELSE '' END AS company,
    CAST(NULL AS VARCHAR) AS salary_text, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS offer_markdown,
    CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS match_score, CAST(NULL AS VARCHAR) AS match_reason, CAST(NULL AS VARCHAR) AS summary,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'matched' WHEN '5-LOW' THEN NULL ELSE 'fetched' END AS status,
    created AS created_at, coalesce(synced, edited) AS updated_at, o_orderpriority <> '5-LOW' AS valid, o_orderkey FROM {_PAGES})"""

_READ = f"(SELECT * FROM {_DECODED} WHERE o_orderkey // {FILE} % 7 <> {CUT_OFF})"
_LOST = f"(SELECT DISTINCT o_orderkey // {FILE} AS no FROM orders WHERE o_orderkey // {FILE} % 7 = {CUT_OFF})"

_TEXT = """CASE WHEN coalesce({0}, '') = '' THEN '{{"rich_text":[]}}' ELSE '{{"rich_text":[{{"type":"text","text":{{"content":"' || {0} || '"}}}}]}}' END"""
_PROPERTIES = f"""(SELECT *, '{{"Name":{{"title":[{{"type":"text","text":{{"content":"' || title || '"}}}}]}},"External ID":' || {_TEXT.format('external_id')}
    || ',"URL":{{"url":"' || url || '"}},"Status":{{"status":{{"name":"' || status || '"}}}},"Source":{{"select":{{"name":"' || source || '"}}}},"Salary":'
    || {_TEXT.format('salary_text')} || ',"Location":' || {_TEXT.format('location')} || ',"Match Score":{{"number":' || coalesce(match_score::VARCHAR, 'null')
    || '}},"Summary":' || {_TEXT.format('summary')} || ',"Created At":{{"date":{{"start":"' || created_at || '"}}}},"Updated At":' || {_TEXT.format('updated_at')}
    || '}}' AS properties_json FROM ({STORED_SQL}))"""

_INDEX = """(SELECT * FROM (SELECT 'orders:/' || o_orderkey AS external_id, 'page-' || o_orderkey || '-' || l_linenumber || '-' || l_partkey AS page_id,
    CASE l_returnflag WHEN 'A' THEN NULL WHEN 'R' THEN '2026-01-01T00:00:00.000Z' ELSE 'stale' END AS synced,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey,
      CASE l_returnflag WHEN 'A' THEN NULL WHEN 'R' THEN '2026-01-01T00:00:00.000Z' ELSE 'stale' END NULLS FIRST) AS rn
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P') WHERE rn = 1)"""

_PLANNED = f"""(SELECT p.*, page_id, CASE WHEN page_id IS NULL THEN 'create' WHEN synced = updated_at THEN 'skip' ELSE 'update' END AS action
  FROM {_PROPERTIES} p LEFT JOIN {_INDEX} i ON p.external_id = i.external_id)"""

_SENT = f"""(SELECT external_id, action, CASE WHEN action = 'update' AND match_score IS NULL THEN 'validation failed' END AS error FROM {_PLANNED})"""

_SYNC_SUMMARY = f"""
        SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE error IS NULL AND action = 'create')::BIGINT AS created,
          count(*) FILTER (WHERE error IS NULL AND action = 'update')::BIGINT AS updated,
          count(*) FILTER (WHERE error IS NULL AND action = 'skip')::BIGINT AS skipped, count(error)::BIGINT AS failed FROM {_SENT}"""

ORACLE = {
    "page_catalog": """
        SELECT 'Name' AS name, 'title' AS type FROM orders UNION SELECT 'External ID', 'rich_text' FROM orders
        UNION SELECT 'URL', 'url' FROM orders UNION SELECT 'Match Score', 'number' FROM orders
        UNION SELECT 'Status', 'status' FROM orders WHERE o_orderpriority <> '5-LOW'
        UNION SELECT 'Source', 'select' FROM orders WHERE o_orderstatus <> 'O'
        UNION SELECT 'Company', 'rich_text' FROM orders WHERE o_orderpriority = '2-HIGH'
        UNION SELECT 'Updated At', CASE o_orderpriority WHEN '1-URGENT' THEN 'date' ELSE 'rich_text' END FROM orders
          WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "schema_check": """
        SELECT 'Salary' AS name, 'number' AS type, 'Optional property "Salary" must use one of: rich_text' AS message
          FROM orders WHERE o_orderpriority = '2-HIGH'
        UNION SELECT 'URL', NULL, 'Missing required property: "URL"' FROM orders""",
    "import_decode": f"SELECT * EXCLUDE (o_orderkey) FROM {_DECODED}",
    "import_rows": f"""
        SELECT external_id, url, status, match_score, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY o_orderkey DESC) AS rn
          FROM (SELECT * REPLACE (CASE WHEN company <> '' THEN source || ':/' || company || '/' || status ELSE external_id END AS external_id)
            FROM {_DECODED} WHERE valid)) WHERE rn = 1""",
    "import_summary": f"""
        SELECT (SELECT count(*) FROM {_READ}) + (SELECT count(*) FROM {_LOST}) AS total,
          (SELECT count(*) FILTER (WHERE valid) FROM {_READ}) AS imported, (SELECT count(*) FILTER (WHERE NOT valid) FROM {_READ}) AS skipped,
          (SELECT count(*) FROM {_LOST}) AS failed""",
    "import_state": f"SELECT external_id, source, url, title, company, match_score, status, updated_at FROM {_READ} WHERE valid",
    "import_failures": f"SELECT 'batch is not readable' AS error, true AS whole FROM {_LOST}",
    "build_properties": f"SELECT external_id, properties_json FROM {_PROPERTIES}",
    "external_index": f"""
        SELECT external_id, 'page-' || o_orderkey AS page_id, synced AS synced_updated_at FROM {_PAGES}""",
    "sync_plan": f"SELECT external_id, page_id, action FROM {_PLANNED}",
    "sync_changeset": f"""
        SELECT action, page_id, external_id, md5(properties_json) AS digest FROM {_PLANNED} WHERE action <> 'skip'""",
    "sync_summary": _SYNC_SUMMARY,
    "sync_line": f"""
        SELECT 'syncing | processed ' || total || '/' || total || ' | created ' || created || ' | updated ' || updated
          || ' | skipped ' || skipped || ' | failed ' || failed AS line FROM ({_SYNC_SUMMARY})""",
    "sync_errors": f"SELECT external_id, external_id || ': ' || error AS error FROM {_SENT} WHERE error IS NOT NULL",
}
