"""Landed pages, offer texts and the profile document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import strip_scheme
from leadloom.operators.keys import key_filter
from leadloom.operators.listing import collapse_last
from leadloom.schemas import OFFERS, PAGES
from leadloom.session import stage


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed listing pages, one row per page."""
    return spark.read.schema(PAGES).format(fmt).load(path)


def read_offers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed offer texts, one row per fetch."""
    return spark.read.schema(OFFERS).format(fmt).load(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile document as one row; an unreadable file fails here."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("profile"))


def required_html(html: Column, url: Column) -> Column:
    """The page text, or an error naming the address that was never landed."""
    return F.when(html.isNotNull(), html).otherwise(
        F.raise_error(F.concat(F.lit("Request failed for "), url)).cast("string")
    )


def scan_pages(frontier: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """Landed pages of the addresses to visit.

    Strict mode keeps every address and fails on the first one without a page.
    """
    landed = pages.select("url", "html")
    if not strict:
        return frontier.join(landed, "url")
    return frontier.join(landed, "url", "left").withColumn(
        "html", required_html(F.col("html"), F.col("url"))
    )


def with_landing(df: DataFrame) -> DataFrame:
    """Rows with a ``landed_at``, NULL where the table has none."""
    return df if "landed_at" in df.columns else df.withColumn("landed_at", F.lit(None).cast("string"))


def landed_in(newest: DataFrame) -> Column:
    """Landings that hold a newest row: the partitions, or row groups, to read.

    ``newest`` is a written table.  A landing is one run's, so there are few.
    """
    times = [r["landed_at"] for r in newest.select("landed_at").distinct().collect()]
    known = F.col("landed_at").isin([t for t in times if t is not None])
    return known | F.col("landed_at").isNull() if None in times else known


def offer_join(listings: DataFrame, offers: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add the offer text by address without scheme.

    ``error`` is set where no text was landed.  The last landing of an address
    counts, by ``order`` or else by ``landed_at``, NULL being the oldest; of equal
    ones always the same.

    Texts move only if they are asked for: addresses and landings are looked at
    first, without the texts; a filter by their keys then drops the other texts
    where they are scanned.
    """
    order = order or ["landed_at"]
    rows = with_landing(offers).withColumn("__address", strip_scheme(F.col("url")))
    asked = listings.withColumn("__address", strip_scheme(F.col("url")))
    addresses = stage(asked.select("__address").distinct(), "addresses")
    wanted = key_filter(addresses, ["__address"])
    by = {f"__by{i}": F.col(c) for i, c in enumerate(order)}
    seen = rows.where(wanted(F.col("__address"))).select("__address", *(c.alias(n) for n, c in by.items()))
    newest = stage(
        seen.join(addresses, "__address", "left_semi").groupBy("__address").agg(F.max(F.struct(*by)).alias("__top")).select("__address", "__top.*"),
        "landings",
    )
    last = key_filter(newest, ["__address", *by])
    if order == ["landed_at"]:
        rows = rows.where(landed_in(newest.withColumnRenamed("__by0", "landed_at")))
    texts = rows.where(last(F.col("__address"), *by.values())).select(
        "__address",
        "offer_markdown",
        F.col("error").alias("__error"),
        *(c.alias(n) for n, c in by.items()),
    )
    # of landings at the same time the greatest text counts
    texts = texts.withColumns({"__text": F.col("offer_markdown"), "__problem": F.col("__error")})
    ranks = [*by, "__text", "__problem"]
    texts = collapse_last(texts, ["__address"], ranks).drop(*ranks)
    joined = asked.join(texts, "__address", "left")
    failed = F.col("__error").isNotNull() | F.col("offer_markdown").isNull()
    return joined.select(
        *listings.columns,
        F.when(~failed, F.col("offer_markdown")).alias("offer_markdown"),
        F.when(failed, F.coalesce("__error", F.lit("no offer text"))).alias("error"),
    )
