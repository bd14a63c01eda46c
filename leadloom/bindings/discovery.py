"""Union, dedupe, page prefix, caps, and a whole crawl over landed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.cards import PER_PAGE, block_pages, flat_pages, headed_pages
from leadloom.bindings.tables import table
from leadloom.functions import urls as U
from leadloom.operators import listing as L
from leadloom.plans.discover import discover
from leadloom.schemas import RunConfig, SourceConfig
from leadloom.session import work_folder
from leadloom.sources.boards import select_sources
from leadloom.sources.pages import read_pages

c = F.col

CAP = 25
# Documents per page; a page holds a run of ids of every source.
DOCS = 200


def source_select(spark, d):
    """Each document source is a configured source; mostly English ones are enabled."""
    counted = table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("max_listings"),
        (F.count_if(c("lang") == "en") * 2 >= F.count(F.lit(1))).alias("enabled"),
    )
    rows = counted.orderBy(F.regexp_extract("source", "[0-9]+", 0).cast("int")).collect()
    config = RunConfig(tuple(SourceConfig(r.source, "", {}, r.max_listings, r.enabled) for r in rows))
    chosen = select_sources(config)
    selected = spark.createDataFrame([(s.source, s.max_listings) for s in chosen], "source string, max_listings bigint")
    return selected.select("source", F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("source_rank"), "max_listings")


def union_sources(spark, d):
    customers = table(spark, d, "customer").select(
        c("c_custkey").alias("id"), c("c_name").alias("title"), c("c_acctbal").alias("amount"), c("c_mktsegment").alias("company")
    )
    suppliers = table(spark, d, "supplier").select(
        c("s_acctbal").alias("amount"), c("s_suppkey").alias("id"), c("s_name").alias("title")
    )
    return L.union_sources([customers, suppliers])


def _crawled(spark, d):
    return table(spark, d, "pages").select(
        U.external_id(F.lit("web"), c("url")).alias("external_id"), "page_id", "url"
    )


def collapse_last_value(spark, d):
    return L.collapse_last_value(_crawled(spark, d), ["external_id"], "page_id")


def dedupe_first(spark, d):
    return L.dedupe_first(_crawled(spark, d), ["external_id"], ["page_id"])


def collapse_last(spark, d):
    return L.collapse_last(_crawled(spark, d), ["external_id"], ["page_id"])


def _documents(spark, d):
    page_no = (F.floor(c("doc_id") / DOCS) + 1).cast("int")
    return table(spark, d, "documents").select("source", page_no.alias("page_no"), c("doc_id").alias("pos"), "lang")


def _counted(spark, d):
    """A page without a German document has no link to more pages."""
    return _documents(spark, d).groupBy("source", "page_no").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(c("lang") == "de") == 0).alias("last")
    )


def page_prefix(spark, d):
    return L.page_prefix(_counted(spark, d), CAP, last="last")


def page_prefix_until_empty(spark, d):
    return L.page_prefix(_counted(spark, d).drop("last"), 1_000_000)


def cap_per_source(spark, d):
    kept = L.page_prefix(_counted(spark, d).drop("last"), CAP)
    return L.cap_rows(_documents(spark, d), kept, CAP).select(
        "source", "page_no", c("pos").alias("doc_id"), c("rank").cast("long").alias("rank")
    )


ALL = 1_000_000_000
#: Listings taken from the flat board, which has one page.
FLAT_CAP = 12
#: Caps of the two paged boards where they bind: within the third and the fifth page.
CAPS = (50, 90)


def crawl_config(headed_cap: int = ALL, block_cap: int = ALL) -> RunConfig:
    """Three boards; without a binding cap a crawl takes the whole tables of the paged ones."""
    return RunConfig(
        sources=(
            SourceConfig("justjoinit", "https://justjoin.it", {"keyword": "night shift"}, FLAT_CAP),
            SourceConfig("nofluffjobs", "https://nofluffjobs.com", {"keyword": "small ring", "location": "Łódź"}, headed_cap),
            SourceConfig("bulldogjob", "https://bulldogjob.com", {"keyword": "Node JS"}, block_cap),
        ),
        match_threshold=0.4,
    )


def _closed(pages):
    """Pages and the empty one behind the last."""
    end = pages.agg((F.max("page_no") + 1).alias("page_no")).select("page_no", F.lit("<main>no more offers</main>").alias("html"))
    return pages.select("page_no", "html").unionByName(end)


def _numbered(address, separator):
    return F.concat(F.lit(address), F.when(c("page_no") > 1, F.concat(F.lit(separator), c("page_no"))).otherwise(""))


def landed_pages(spark, d):
    """The built pages, written and read back as a crawl finds them."""
    folder = work_folder(spark, "landed")
    built_pages(spark, d).write.parquet(folder)
    return read_pages(spark, folder)


def built_pages(spark, d):
    """Board pages of the customer, part and orders tables, under the addresses of the search.

    A page of the second board also shows the first card of the page before it
    once more, under another title.
    """
    seen = F.concat(
        F.lit("<a href='/pl/job/part-"), (c("page_no") - 2) * PER_PAGE, F.lit("'><h3>Seen before</h3><h4>Elsewhere</h4></a></main>")
    )
    flat = flat_pages(spark, d).select(
        F.lit("justjoinit").alias("source"), "page_no", F.lit("https://justjoin.it/job-offers/all-locations?keyword=night+shift").alias("url"), "html"
    )
    parts = _closed(headed_pages(spark, d)).select(
        F.lit("nofluffjobs").alias("source"), "page_no",
        _numbered("https://nofluffjobs.com/pl/%C5%82%C3%B3d%C5%BA/small-ring", "?page=").alias("url"),
        F.when((c("page_no") > 1) & F.contains("html", F.lit("nfjloadmore")), F.replace("html", F.lit("</main>"), seen)).otherwise(c("html")).alias("html"),
    )
    orders = _closed(block_pages(spark, d)).select(
        F.lit("bulldogjob").alias("source"), "page_no",
        _numbered("https://bulldogjob.com/companies/jobs/s/skills,Node%20JS", "/page,").alias("url"), "html",
    )
    return flat.unionByName(parts).unionByName(orders)


def crawl_listings(spark, d):
    return discover(landed_pages(spark, d), crawl_config())


def crawl_capped(spark, d):
    """The paged boards are crawled up to caps that end in the middle of a page."""
    return discover(landed_pages(spark, d), crawl_config(*CAPS))


def crawl_relanded(spark, d):
    """Pages landed up to three times, read back: without a time, on a first day, and the even ones again later."""
    now = landed_pages(spark, d).drop("landed_at")

    def titled(mark):
        return now.withColumn("html", F.regexp_replace("html", "<h([23])>", f"<h$1>{mark} "))

    folder = work_folder(spark, "pages")
    titled("Undated").withColumn("landed_at", F.lit(None).cast("string")).write.partitionBy("landed_at").parquet(folder)
    titled("Earlier").withColumn("landed_at", F.lit("2026-01-01T06:00:00.000Z")).write.mode("append").partitionBy("landed_at").parquet(folder)
    later = now.where("page_no % 2 = 0").withColumn("landed_at", F.lit("2026-01-02T06:00:00.000Z"))
    later.write.mode("append").partitionBy("landed_at").parquet(folder)
    return discover(read_pages(spark, folder), crawl_config())


QUERIES = {
    "source_select": source_select,
    "union_sources": union_sources,
    "collapse_last_value": collapse_last_value,
    "dedupe_first": dedupe_first,
    "collapse_last": collapse_last,
    "page_prefix": page_prefix,
    "page_prefix_until_empty": page_prefix_until_empty,
    "cap_per_source": cap_per_source,
    "crawl_listings": crawl_listings,
    "crawl_capped": crawl_capped,
    "crawl_relanded": crawl_relanded,
}

_WEB = """
  SELECT 'web:' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS external_id, page_id, url
  FROM pages"""

_COUNTED = f"""counted AS (
  SELECT source, (doc_id // {DOCS} + 1)::INTEGER AS page_no, count(*)::BIGINT AS n,
    count(*) FILTER (WHERE lang = 'de') = 0 AS last FROM documents GROUP BY ALL)"""


def _prefix(stop: str, cap: int) -> str:
    return f"""walked AS (SELECT *,
      coalesce(sum(n) OVER w, 0)::BIGINT AS before, count(*) OVER w AS seen,
      coalesce(max(CASE WHEN {stop} THEN 1 ELSE 0 END) OVER w, 0) AS stopped
    FROM counted WINDOW w AS (PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  kept AS (SELECT * FROM walked WHERE stopped = 0 AND seen = page_no - 1 AND before < {cap})"""


FLAT_LISTINGS = f"""
  SELECT 'justjoinit:/job-offer/customer-' || c_custkey AS external_id, 'justjoinit' AS source,
    'https://justjoin.it/job-offer/customer-' || c_custkey || '?from=' || c_nationkey AS url, c_name AS title, 'R&D ' || c_mktsegment AS company,
    CASE WHEN c_acctbal >= 1000 THEN floor(c_acctbal)::BIGINT || ' to ' || (floor(c_acctbal)::BIGINT + 500) || ' EUR a month' END AS salary_text,
    'NATION_' || c_nationkey AS location, 1 AS page_no, c_custkey::INTEGER AS pos
  FROM customer WHERE c_custkey < {PER_PAGE} ORDER BY c_custkey LIMIT {FLAT_CAP}"""


def _listings(parts: int = ALL, orders: int = ALL) -> str:
    return f"""
  SELECT * FROM ({FLAT_LISTINGS}) UNION ALL
  SELECT 'nofluffjobs:/pl/job/part-' || p_partkey AS external_id, 'nofluffjobs' AS source,
    'https://nofluffjobs.com/pl/job/part-' || p_partkey AS url, p_name AS title, p_brand AS company,
    floor(p_retailprice)::BIGINT || ' - ' || (floor(p_retailprice)::BIGINT + 100) || ' PLN' AS salary_text,
    p_type AS location, (p_partkey // {PER_PAGE} + 1)::INTEGER AS page_no, (2 * (p_partkey % {PER_PAGE}))::INTEGER AS pos
  FROM part WHERE p_partkey + greatest(p_partkey // {PER_PAGE} - 1, 0) < {parts} UNION ALL
  SELECT 'bulldogjob:/companies/jobs/' || o_orderkey || '-' || replace(lower(o_orderpriority), ' ', '%20'), 'bulldogjob',
    'https://bulldogjob.com/companies/jobs/' || o_orderkey || '-' || replace(lower(o_orderpriority), ' ', '%20'),
    'Order ' || o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'Logo ' ELSE 'Customer ' END || o_custkey,
    CAST(NULL AS VARCHAR), o_orderstatus, (o_orderkey // {PER_PAGE} + 1)::INTEGER, (2 * (o_orderkey % {PER_PAGE}))::INTEGER
  FROM orders WHERE o_orderkey < {orders}"""


ORACLE = {
    "source_select": """
        SELECT source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS source_rank, count(*)::BIGINT AS max_listings
        FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang = 'en') * 2 >= count(*)""",
    "union_sources": """
        SELECT c_custkey AS id, c_name AS title, c_acctbal AS amount, c_mktsegment AS company, 1 AS source_rank FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 2 FROM supplier""",
    "collapse_last_value": f"""
        SELECT external_id, min(page_id) AS page_id, arg_max(url, page_id) AS url FROM ({_WEB}) GROUP BY external_id""",
    "dedupe_first": f"""
        SELECT external_id, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM ({_WEB}) GROUP BY external_id""",
    "collapse_last": f"""
        SELECT external_id, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM ({_WEB}) GROUP BY external_id""",
    "page_prefix": f"""
        WITH {_COUNTED}, {_prefix('last', CAP)} SELECT source, page_no, n, last, before FROM kept""",
    "page_prefix_until_empty": f"""
        WITH {_COUNTED}, {_prefix('n = 0', 1_000_000)} SELECT source, page_no, n, before FROM kept""",
    "cap_per_source": f"""
        WITH {_COUNTED}, {_prefix('n = 0', CAP)},
        docs AS (SELECT source, (doc_id // {DOCS} + 1)::INTEGER AS page_no, doc_id FROM documents)
        SELECT * FROM (SELECT docs.source, docs.page_no, doc_id,
            before + row_number() OVER (PARTITION BY docs.source, docs.page_no ORDER BY doc_id) AS rank
          FROM docs JOIN kept ON docs.source = kept.source AND docs.page_no = kept.page_no) WHERE rank <= {CAP}""",
    "crawl_listings": _listings(),
    "crawl_capped": _listings(*CAPS),
    "crawl_relanded": f"SELECT * REPLACE (CASE WHEN page_no % 2 = 1 THEN 'Earlier ' ELSE '' END || title AS title) FROM ({_listings()})",
}
