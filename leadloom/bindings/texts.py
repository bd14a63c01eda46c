"""Text and URL functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.tables import table
from leadloom.functions import html as H
from leadloom.functions import text as T
from leadloom.functions import urls as U
from leadloom.schemas import STATUSES

c = F.col

# White space class of the pages, in the pattern syntax of the checking engine.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def clean_text(spark, d):
    cleaned = table(spark, d, "documents").select("doc_id", T.clean_text(c("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def slugify(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.slugify(F.concat(F.lit(" "), c("p_name"), F.lit(" \t "), c("p_brand"))).alias("slug")
    )


def strip_suffix(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        T.strip_more_places(T.clean_text(F.concat(c("p_type"), F.lit(" + "), c("p_brand"), F.lit("  +"), c("p_size"), F.lit(" more")))).alias("place"),
        T.strip_new_mark(T.clean_text(F.concat(c("p_name"), F.when(c("p_size") > 25, F.lit("  NOWA")).otherwise(" NOWA 2")))).alias("title"),
    )


def salary_flag(spark, d):
    text = F.concat_ws(
        " ", c("o_totalprice").cast("long").cast("string"),
        F.when(c("o_orderstatus") == "F", F.lit("pln/month"))
        .when(c("o_orderstatus") == "O", F.lit("EURO"))
        .when(c("o_orderpriority") == "5-LOW", F.lit("undisclosed  salary"))
        .when(c("o_orderpriority") == "2-HIGH", F.lit("Undisclosed Salary"))
        .otherwise(c("o_orderpriority")),
    )
    return table(spark, d, "orders").select("o_orderkey", T.has_currency(text).alias("is_salary"))


def salary_range(spark, d):
    low = c("o_totalprice").cast("long").cast("string")
    text = (
        F.when(c("o_orderstatus") == "F", F.concat(low, F.lit(" – "), c("o_custkey"), F.lit(" 000 PLN")))
        .when(c("o_orderstatus") == "O", F.concat(F.lit("od"), low, F.lit("PLN")))
        .otherwise(F.concat(F.lit("B2B "), low, F.lit("  PLN, "), c("o_orderpriority")))
    )
    return table(spark, d, "orders").select(
        "o_orderkey", T.has_amount(text).alias("is_salary"), T.plain_dashes(text).alias("salary_text")
    )


def normalize_enum(spark, d):
    word = F.lower(F.when(c("event_type") == "error", c("event_type")).otherwise(F.concat(c("event_type"), F.lit("ed"))))
    named = F.when(c("event_type") == "view", F.lit("matched")).otherwise(word)
    key = F.concat(c("event_type"), F.lit(":"), c("user_id"))
    return table(spark, d, "events").select(
        "event_id",
        T.in_domain(named, STATUSES).alias("status"),
        T.in_domain(T.id_prefix(key), ["click", "view"]).alias("source"),
    )


def iso_time(spark, d):
    return table(spark, d, "events").select("event_id", T.iso_time(c("ts")).alias("created_at"))


def _filters(spark, d):
    return table(spark, d, "part").withColumn("base_url", F.lit("https://jobs.example.com/start"))


def frontier_query(spark, d):
    url = U.query_search_url(
        c("base_url"),
        c("p_name"),
        F.when(c("p_type") != "SMALL", c("p_type")),
        c("p_brand"),
        F.lit(None).cast("string"),
        F.lower(c("p_type")),
        (c("p_size") - 1).cast("double"),
        F.when(c("p_retailprice") > 950, F.lit("PLN")).otherwise(""),
        c("p_size") > 40,
    )
    return _filters(spark, d).select("p_partkey", url.alias("url"))


def _paged(spark, d):
    return _filters(spark, d).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_no"))


def frontier_path(spark, d):
    url = U.path_search_url(c("base_url"), c("p_type"), c("p_name"), c("page_no"))
    return _paged(spark, d).select("p_partkey", "page_no", url.alias("url"))


def frontier_comma(spark, d):
    keyword = F.concat(F.lit(" "), c("p_name"), F.lit("~('"), c("p_brand"), F.lit("'); "))
    url = U.comma_search_url(c("base_url"), keyword, c("page_no"))
    return _paged(spark, d).select("p_partkey", "page_no", url.alias("url"))


def external_id(spark, d):
    return table(spark, d, "pages").select("page_id", U.external_id(F.lit("web"), c("url")).alias("external_id"))


def resolve_url(spark, d):
    found = table(spark, d, "pages").select("page_id", "url", F.posexplode(H.anchors(c("html"))).alias("pos", "card"))
    href = H.attribute(c("card"), "href")
    return found.select("page_id", "pos", href.alias("href"), U.resolve(href, c("url")).alias("url"))


# The salary patterns, as the boards' texts are read.
CURRENCY = r"(?i)\b(PLN|USD|EUR|CHF)\b"
UNDISCLOSED = "(?i)Undisclosed Salary"
AMOUNT_RANGE = r"\b\d[\d\s]*(?:-|–)\s*\d[\d\s]*\s+PLN\b"
AMOUNT = r"\b\d[\d\s]*\s+PLN\b"

QUERIES = {
    "clean_text": clean_text,
    "slugify": slugify,
    "strip_suffix": strip_suffix,
    "salary_flag": salary_flag,
    "salary_range": salary_range,
    "normalize_enum": normalize_enum,
    "iso_time": iso_time,
    "frontier_query": frontier_query,
    "frontier_path": frontier_path,
    "frontier_comma": frontier_comma,
    "external_id": external_id,
    "resolve_url": resolve_url,
}

ORACLE = {
    "clean_text": rf"""
        SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (
          SELECT doc_id, nullif(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '') AS t FROM documents)""",
    "slugify": r"""
        SELECT p_partkey, regexp_replace(lower(trim(p_name || ' ' || p_brand)), '\s+', '-', 'g') AS slug FROM part""",
    "strip_suffix": r"""
        SELECT p_partkey, p_type || ' + ' || p_brand AS place,
               CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' NOWA 2' END AS title FROM part""",
    "salary_flag": f"""
        SELECT o_orderkey, coalesce(regexp_matches(t, '{CURRENCY}') OR regexp_matches(t, '{UNDISCLOSED}'), false) AS is_salary
        FROM (SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || ' ' || CASE
            WHEN o_orderstatus = 'F' THEN 'pln/month' WHEN o_orderstatus = 'O' THEN 'EURO'
            WHEN o_orderpriority = '5-LOW' THEN 'undisclosed  salary'
            WHEN o_orderpriority = '2-HIGH' THEN 'Undisclosed Salary' ELSE o_orderpriority END AS t FROM orders)""",
    "salary_range": f"""
        SELECT o_orderkey, regexp_matches(t, '{AMOUNT_RANGE}') OR regexp_matches(t, '{AMOUNT}') AS is_salary,
          replace(t, '–', '-') AS salary_text
        FROM (SELECT o_orderkey, CASE
            WHEN o_orderstatus = 'F' THEN low || ' – ' || o_custkey || ' 000 PLN'
            WHEN o_orderstatus = 'O' THEN 'od' || low || 'PLN'
            ELSE 'B2B ' || low || '  PLN, ' || o_orderpriority END AS t
          FROM (SELECT *, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS low FROM orders))""",
    "normalize_enum": """
        SELECT event_id,
          CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'matched' END AS status,
          CASE WHEN event_type IN ('click', 'view') THEN event_type END AS source
        FROM events""",
    "iso_time": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(date_part('microseconds', ts) % 1000000 / 1000) AS BIGINT)::VARCHAR, 3, '0') || 'Z' AS created_at
        FROM events""",
    "frontier_query": """
        SELECT p_partkey, 'https://jobs.example.com/job-offers/all-locations?' || concat_ws('&',
          'keyword=' || replace(url_encode(p_name), '%20', '+'),
          CASE WHEN p_type <> 'SMALL' THEN 'category=' || url_encode(p_type) END,
          'location=' || url_encode(p_brand),
          'experience-level=' || url_encode(lower(p_type)),
          CASE WHEN p_size > 1 THEN 'salary-from=' || (p_size - 1) END,
          CASE WHEN p_retailprice > 950 THEN 'salary-currency=PLN' END,
          CASE WHEN p_size > 40 THEN 'with-salary=true' END) AS url
        FROM part""",
    "frontier_path": """
        SELECT p_partkey, page_no, 'https://jobs.example.com/pl/' || lower(p_type) || '/' || replace(lower(p_name), ' ', '-')
          || CASE WHEN page_no > 1 THEN '?page=' || page_no ELSE '' END AS url
        FROM part, (SELECT unnest([1, 2, 3])::INTEGER AS page_no)""",
    "frontier_comma": """
        SELECT p_partkey, page_no, 'https://jobs.example.com/companies/jobs/s/skills,'
          || url_encode(p_name) || '~(''' || url_encode(p_brand) || ''')%3B'
          || CASE WHEN page_no > 1 THEN '/page,' || page_no ELSE '' END AS url
        FROM part, (SELECT unnest([1, 2, 3])::INTEGER AS page_no)""",
    "external_id": """
        SELECT page_id, 'web:' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS external_id
        FROM pages""",
    "resolve_url": """
        SELECT page_id, (pos - 1)::INTEGER AS pos, href,
          regexp_extract(url, '^[a-z]+://[^/]+') || '/' || replace(url_encode(substr(href, 2)), '%2C', ',') AS url
        FROM (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (
          SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1) AS hrefs FROM pages))""",
}
