"""Reading cards: over the raw pages, and over board pages built from other tables.

The board pages hold one card per row of a table in the markup of a board, so
the expected listing is known from the row itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.tables import table
from leadloom.functions import html as H
from leadloom.functions.let import bind, let
from leadloom.sources import boards as B
from leadloom.sources.pages import required_html

c = F.col
PER_PAGE = 20


def _pages_of(cards, key, source, base_url, more=""):
    """Put cards (``key, card``) on pages of PER_PAGE keys each."""
    page_no = (F.floor(c(key) / PER_PAGE) + 1).cast("int")
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(c(key), c("card")))), lambda x: x["card"]), "\n"
    )
    return cards.groupBy(page_no.alias("page_no")).agg(body.alias("body")).select(
        F.lit(source).alias("source"),
        "page_no",
        F.lit(base_url).alias("base_url"),
        F.concat(F.lit("<html><!-- a --><body><main>"), c("body"), F.lit(more), F.lit("</main></body></html>")).alias("html"),
    )


def flat_pages(spark, d):
    salary = F.when(c("c_acctbal") < 1000, F.lit("Undisclosed Salary")).otherwise(
        F.concat(F.floor("c_acctbal"), F.lit(" to "), F.floor("c_acctbal") + 500, F.lit(" EUR a month"))
    )
    card = F.concat(
        F.lit('<a data-job="c" href="/job-offer/customer-'), c("c_custkey"), F.lit("?from="), c("c_nationkey"),
        F.lit('"><section><em>New</em><h2>'), c("c_name"), F.lit("</h2></section><table><tr><td>R&amp;D "), c("c_mktsegment"),
        F.lit("</td><td><!-- pay -->"), salary, F.lit("</td><td>NATION_"), c("c_nationkey"),
        F.lit("</td></tr></table><ul><li>Hybrid<li>Permanent</li><li>Expires tomorrow</li></ul></a>"),
    )
    cards = table(spark, d, "customer").select("c_custkey", card.alias("card"))
    return _pages_of(cards, "c_custkey", "justjoinit", "https://justjoin.it")


def headed_pages(spark, d):
    price = F.floor("p_retailprice")
    card = F.concat(
        F.lit("<a href='/pl/job/part-"), c("p_partkey"), F.lit("' class=posting><article><h3>"), c("p_name"),
        F.lit(" <b>NOWA</b></h3><div>"), price, F.lit(" – "), price + 100,
        F.lit(" PLN</div><div><span>Frontend</span><span>"), c("p_size"), F.lit("</span></div><h4>"), c("p_brand"),
        F.lit("</h4><p>x</p><div><i></i><span>"), c("p_type"), F.lit("</span> <span>+"), c("p_size"),
        F.lit("</span></div></article></a><a href='/pl/other'>other</a>"),
    )
    cards = table(spark, d, "part").select("p_partkey", card.alias("card"))
    return _pages_of(cards, "p_partkey", "nofluffjobs", "https://nofluffjobs.com", "<button nfjloadmore>more</button>")


def block_pages(spark, d):
    logo = F.when(c("o_orderstatus") == "F", F.concat(F.lit('<img src="x.png" alt="Logo '), c("o_custkey"), F.lit('" />'))).otherwise("")
    card = F.concat(
        F.lit('<a href="https://bulldogjob.com/companies/jobs/'), c("o_orderkey"), F.lit("-"), F.lower("o_orderpriority"),
        F.lit('">'), logo, F.lit("<div><h3>Order "), c("o_orderpriority"), F.lit("</h3><div>Customer <b>"), c("o_custkey"),
        F.lit("</b></div></div><section><div>"), c("o_orderstatus"), F.lit("</div><div>Full-time</div></section></a>"),
        F.lit('<a href="/companies/jobs/s/skills">more</a>'),
    )
    cards = table(spark, d, "orders").select("o_orderkey", card.alias("card"))
    return _pages_of(cards, "o_orderkey", "bulldogjob", "https://bulldogjob.com")


def pages_scan(spark, d):
    checked = required_html(c("html"), c("url"))
    return table(spark, d, "pages").select("page_id", "url", F.length(checked).cast("long").alias("n_chars"))


def extract_anchors(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    found = B.cards(pages, lambda href: href.startswith("/"))
    return found.select("page_id", "pos", "href", F.md5("card").alias("digest"))


def _leaves(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return H.with_leaf_texts(pages.withColumn("html", H.strip_silent(c("html"))), "html")


def leaf_texts(spark, d):
    rows = _leaves(spark, d).select("page_id", F.posexplode("leaves").alias("pos", "leaf"))
    return rows.select("page_id", "pos", "leaf.tag", "leaf.text")


def consecutive_dedupe(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    kept = lines.withColumn("kept", H.drop_repeats(c("lines")))
    return kept.select(
        "doc_id",
        F.size("lines").alias("n_lines"),
        F.size("kept").alias("n_kept"),
        F.md5(F.array_join("kept", "\n")).alias("digest"),
    )


def classify_fields(spark, d):
    return B.with_ordered_fields(_leaves(spark, d)).select("page_id", "title", "company", "location", "salary_text")


def classify_tags(spark, d):
    def fields(t):
        h1 = H.find_open(t, "h1")
        return F.struct(
            H.element_text(t, h1).alias("title"),
            H.element_text(t, H.find_open(t, "li")).alias("company"),
            H.element_text(t, H.later_sibling(t, H.find_open(t, "nav"), ["div"])).alias("location"),
            F.get(t["names"], H.parent_of(t, h1) - 1).alias("block"),
        )

    tree = let(H.tokens(H.strip_silent(c("html"))), H.tree)
    return bind(table(spark, d, "pages"), tree, fields, ["page_id"])


def extract_listings(spark, d):
    """One listing per raw page: the page is the card and its own address the link."""
    rows = B.with_ordered_fields(_leaves(spark, d)).select(
        F.lit("web").alias("source"), "title", "company", "salary_text", "location", c("url").alias("href"), c("url").alias("base_url"),
        F.lit(1).alias("page_no"), c("page_id").alias("pos"),
    )
    return B.to_listings(B.with_address(rows))


_LISTING = ["external_id", "source", "url", "title", "company", "salary_text", "location", "page_no", "pos"]


def _read(pages, source):
    return B.read_cards(pages, {source: B.BOARDS[source].read}).select(_LISTING)


def extract_flat_cards(spark, d):
    return _read(flat_pages(spark, d), "justjoinit")


def extract_headed_cards(spark, d):
    return _read(headed_pages(spark, d), "nofluffjobs")


def extract_block_cards(spark, d):
    return _read(block_pages(spark, d), "bulldogjob")


QUERIES = {
    "pages_scan": pages_scan,
    "extract_anchors": extract_anchors,
    "leaf_texts": leaf_texts,
    "consecutive_dedupe": consecutive_dedupe,
    "classify_fields": classify_fields,
    "classify_tags": classify_tags,
    "extract_listings": extract_listings,
    "extract_flat_cards": extract_flat_cards,
    "extract_headed_cards": extract_headed_cards,
    "extract_block_cards": extract_block_cards,
}

# Cleaned text of a markup fragment.
_CLEAN = r"""nullif(trim(regexp_replace(replace(replace(replace(replace({0}, '&quot;', '"'), '&copy;', '©'),
  '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')), '')"""

# Leaf texts of a page: elements without child elements, comments and the
# contents of scripts and styles left out, direct repeats dropped.
_LEAVES_SQL = r"""
  bare AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script[^>]*>.*?</script>', '<script></script>', 'g'), '(?is)<style[^>]*>.*?</style>', '<style></style>', 'g') AS html FROM pages),
  raw AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<[a-z][a-z0-9]*(?:\s[^>]*)?>[^<]*</[a-z][a-z0-9]*>') AS els FROM bare),
  els AS (SELECT page_id, url, unnest(els) AS e, generate_subscripts(els, 1) AS i FROM raw),
  parsed AS (SELECT page_id, url, i, regexp_extract(e, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(e, '</([a-z0-9]+)>$', 1) AS closed,
      %s AS text FROM els),
  filled AS (SELECT *, lag(text) OVER (PARTITION BY page_id ORDER BY i) AS before FROM parsed
      WHERE tag = closed AND tag NOT IN ('script', 'style', 'svg', 'path') AND text IS NOT NULL),
  leaves AS (SELECT page_id, url, tag, text, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i FROM filled
      WHERE before IS NULL OR before <> text)""" % _CLEAN.format("regexp_extract(e, '(?s)^<[^>]*>([^<]*)<', 1)")

# Salary and label patterns, as the boards' texts are read.
_SALARY = r"(regexp_matches({0}, '(?i)\b(PLN|USD|EUR|CHF)\b') OR regexp_matches({0}, '(?i)Undisclosed Salary'))"
_LABEL = r"""({0} IN ('Super offer', '1-click Apply', 'New', 'Remote', 'Hybrid', 'Office', 'B2B', 'Permanent', 'Internship',
  'Mandate contract', 'Specific-task contract', 'Full-time', 'Part-time', 'Practice / Internship', 'Freelance', 'Junior', 'Mid',
  'Senior', 'Manager / C-level') OR regexp_matches({0}, '(?i)^\d+\s*d left$') OR regexp_matches({0}, '(?i)^Expires tomorrow$'))"""

_FIELDS_SQL = f"""WITH {_LEAVES_SQL},
  marked AS (SELECT *, {_SALARY.format('text')} AS paid, NOT {_LABEL.format('text')} AND NOT {_SALARY.format('text')} AS plain FROM leaves),
  ranked AS (SELECT *, CASE WHEN plain THEN row_number() OVER (PARTITION BY page_id, plain ORDER BY i) END AS n FROM marked),
  spots AS (SELECT page_id, url, max(CASE WHEN n = 1 THEN text END) AS title, max(CASE WHEN n = 2 THEN text END) AS company,
      max(CASE WHEN n = 3 THEN text END) AS location, max(CASE WHEN n = 1 THEN i END) AS ti, max(CASE WHEN n = 3 THEN i END) AS li
      FROM ranked GROUP BY page_id, url),
  fields AS (SELECT spots.page_id, spots.url, title, company, location, arg_min(text, i) AS salary_text
      FROM spots LEFT JOIN marked ON marked.page_id = spots.page_id AND paid AND NOT regexp_matches(text, '(?i)Undisclosed Salary')
        AND i > ti AND (li IS NULL OR i < li) GROUP BY ALL)"""

ORACLE = {
    "pages_scan": "SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages",
    "extract_anchors": """
        SELECT page_id, (pos - 1)::INTEGER AS pos, regexp_extract(card, 'href="([^"]*)"', 1) AS href, md5(card) AS digest
        FROM (SELECT page_id, unnest(cards) AS card, generate_subscripts(cards, 1) AS pos FROM (
          SELECT page_id, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS cards FROM pages))""",
    "leaf_texts": f"""WITH {_LEAVES_SQL}
        SELECT page_id, (i - 1)::INTEGER AS pos, tag, text FROM leaves""",
    "consecutive_dedupe": """
        SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (WHERE keep)::INTEGER AS n_kept,
          md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep)) AS digest
        FROM (SELECT doc_id, i, line, coalesce(line <> lag(line) OVER (PARTITION BY doc_id ORDER BY i), true) AS keep
          FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
        GROUP BY doc_id""",
    "classify_fields": f"{_FIELDS_SQL} SELECT page_id, title, company, location, salary_text FROM fields",
    "extract_listings": f"""{_FIELDS_SQL}
        SELECT 'web:' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS external_id,
          'web' AS source, url, title, company, salary_text, location, 1 AS page_no, page_id AS pos
        FROM fields WHERE title IS NOT NULL AND company IS NOT NULL""",
    "extract_flat_cards": f"""
        SELECT 'justjoinit:/job-offer/customer-' || c_custkey AS external_id, 'justjoinit' AS source,
          'https://justjoin.it/job-offer/customer-' || c_custkey || '?from=' || c_nationkey AS url,
          c_name AS title, 'R&D ' || c_mktsegment AS company,
          CASE WHEN c_acctbal >= 1000 THEN floor(c_acctbal)::BIGINT || ' to ' || (floor(c_acctbal)::BIGINT + 500) || ' EUR a month' END AS salary_text,
          'NATION_' || c_nationkey AS location,
          (c_custkey // {PER_PAGE} + 1)::INTEGER AS page_no, (c_custkey % {PER_PAGE})::INTEGER AS pos
        FROM customer""",
    "extract_headed_cards": f"""
        SELECT 'nofluffjobs:/pl/job/part-' || p_partkey AS external_id, 'nofluffjobs' AS source,
          'https://nofluffjobs.com/pl/job/part-' || p_partkey AS url, p_name AS title, p_brand AS company,
          floor(p_retailprice)::BIGINT || ' - ' || (floor(p_retailprice)::BIGINT + 100) || ' PLN' AS salary_text,
          p_type AS location, (p_partkey // {PER_PAGE} + 1)::INTEGER AS page_no, (2 * (p_partkey % {PER_PAGE}))::INTEGER AS pos
        FROM part""",
    "extract_block_cards": f"""
        SELECT 'bulldogjob:/companies/jobs/' || o_orderkey || '-' || replace(lower(o_orderpriority), ' ', '%20') AS external_id,
          'bulldogjob' AS source,
          'https://bulldogjob.com/companies/jobs/' || o_orderkey || '-' || replace(lower(o_orderpriority), ' ', '%20') AS url,
          'Order ' || o_orderpriority AS title,
          CASE WHEN o_orderstatus = 'F' THEN 'Logo ' ELSE 'Customer ' END || o_custkey AS company,
          CAST(NULL AS VARCHAR) AS salary_text, o_orderstatus AS location,
          (o_orderkey // {PER_PAGE} + 1)::INTEGER AS page_no, (2 * (o_orderkey % {PER_PAGE}))::INTEGER AS pos
        FROM orders""",
}
ORACLE["classify_tags"] = """
    SELECT page_id, {title} AS title, {company} AS company, {location} AS location, 'article' AS block FROM pages
""".format(
    title=_CLEAN.format("regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1)"),
    company=_CLEAN.format("regexp_extract(html, '(?s)<li><a[^>]*>([^<]*)</a></li>', 1)"),
    location=_CLEAN.format("""regexp_extract(html, '(?s)</nav>.*?<div class="ad">([^<]*)</div>', 1)"""),
)
