"""URL filters: rules, and a tree of path templates per host.

A URL that a rule fits gets the rule's verdict.  The others are judged by the
template their path belongs to, learnt from the URLs that rules have labelled:

1. Segments are generalised by shape (digits, long hexadecimal runs), and paths
   are counted per host; from there on only these counts are worked on.
2. Level by level, below each branch, rare segments become the wildcard, and so
   do segments whose pages are labelled (blocked, allowed, not at all) in shares
   that do not differ significantly from those of their siblings together.
3. A template's purity, the share of allowed pages among its labelled ones, is
   smoothed towards that of its parent, from 1/2 at the top.  Templates whose
   purity is at most ``MAX_BAD_PURITY`` are rejected.

Paths keep all their segments.  A path that is the only one left in its branch has
one child on each further level, which keeps its name, so it is done at once; the
others take as many rounds as they have segments.  A null URL, or one without
``://``, has empty host and path; no rule fits it and it is allowed.  Repeated
URLs count as often as they come.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import Staged, take

# The rules of the registered query, as host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

RARE_SHARE, RARE_COUNT = 0.01, 3
SIGNIFICANT = 3.0
SMOOTHING = 10.0
MAX_BAD_PURITY = 0.2


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, judged in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """All segments, with digits and long hexadecimal runs generalised."""
    return F.transform(
        F.split(F.regexp_replace(path, "^/", ""), "/"),
        lambda s: F.regexp_replace(F.regexp_replace(s, "(?<![0-9A-Za-z])[0-9a-f-]{16,}(?![0-9A-Za-z])", "{h}"), "[0-9]+", "{n}"),
    )


def templates(counts: DataFrame, staged: Staged) -> DataFrame:
    """Adds ``template`` (array) to counts per host and shapes; works on the counts alone, one level after the other."""
    sums = ("n", "bad", "good")
    rows = counts.withColumn("template", F.array().cast("array<string>"))
    schema, done, last = rows.schema, f"{staged.base}/done", None
    deepest = counts.agg(F.max(F.size("shapes"))).first()[0]
    if deepest is None:
        return rows
    for level in range(deepest):
        rows = rows.withColumn("segment", F.get("shapes", F.lit(level)))
        children = rows.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in sums), F.count("*").alias("paths"))
        parents = children.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in (*sums, "paths")), F.count("*").alias("children"))
        both = children.join(parents, ["host", "template"])

        def differs(label: str) -> Column:
            """Whether the child's share of a label differs from that of its siblings together."""
            others = F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
            pooled = F.col(f"all_{label}") / F.col("all_n")
            apart = F.abs(F.col(label) / F.col("n") - (F.col(f"all_{label}") - F.col(label)) / others)
            error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / others))
            return others.isNotNull() & (pooled > 0) & (pooled < 1) & (apart >= SIGNIFICANT * error)

        common = (F.col("n") >= RARE_COUNT) & (F.col("n") >= RARE_SHARE * F.col("all_n"))
        own = (F.col("children") == 1) | F.coalesce(common & (differs("bad") | differs("good")), F.lit(False))
        named = both.select("host", "template", "segment", F.when(own, F.col("segment")).otherwise(F.lit("*")).alias("name"), (F.col("all_paths") == 1).alias("alone"))
        rows = rows.join(named, ["host", "template", "segment"])
        grown = F.when(F.col("alone"), F.concat("template", F.slice("shapes", level + 1, F.size("shapes")))).otherwise(F.concat("template", F.array("name")))
        rows, path = staged.write(rows.select("host", "shapes", *sums, grown.alias("template")))
        whole = F.size("template") == F.size("shapes")
        rows.where(whole).write.mode("append").parquet(done)
        if last:
            staged.drop(last)
        rows, last = rows.where(~whole), path
        if rows.isEmpty():
            break
    return counts.sparkSession.read.schema(schema).parquet(done)


def purities(rows: DataFrame) -> DataFrame:
    """``host``, ``template`` and ``purity``: the share of allowed pages, smoothed from the top of the tree down."""
    nodes = rows.select("host", "bad", "good", F.explode(F.sequence(F.lit(1), F.size("template"))).alias("level"), "template")
    nodes = nodes.groupBy("host", "level", F.slice("template", F.lit(1), F.col("level")).alias("node")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    leaves = rows.select("host", "template").distinct()
    chain = leaves.select("host", "template", F.explode(F.sequence(F.lit(1), F.size("template"))).alias("level"))
    chain = chain.withColumn("node", F.slice("template", F.lit(1), F.col("level"))).join(nodes, ["host", "level", "node"])
    steps = chain.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "bad", "good"))).alias("steps"))
    smooth = F.aggregate("steps", F.lit(0.5), lambda above, s: (s["good"] + SMOOTHING * above) / (s["good"] + s["bad"] + SMOOTHING))
    return steps.select("host", "template", smooth.alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    rows = take(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), shapes(F.col("path")).alias("shapes"))
    label = lambda v: F.sum((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("long"))
    staged = Staged(pages.sparkSession, "urls")
    counts, _ = staged.write(rows.groupBy("host", "shapes").agg(F.count("*").alias("n"), label("block").alias("bad"), label("allow").alias("good")))
    tree = templates(counts, staged)
    rejected = tree.join(purities(tree), ["host", "template"]).where(F.col("purity") <= MAX_BAD_PURITY).select("host", "shapes", F.lit("block").alias("learnt"))
    judged = rows.join(rejected, ["host", "shapes"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learnt", F.lit("allow")).alias("verdict"))
