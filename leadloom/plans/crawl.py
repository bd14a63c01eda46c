"""A crawl that arrives in pieces.

Every landed page is kept with its cards, without its markup, as one row of a state
table.  What a crawl takes is worked out from all pages known so far, so pages may
land in any order and in any number of batches: a page behind a gap waits until the
gap is filled.  Work follows what is new: the pages of a batch, and the listings
that only now are within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import listing as L
from leadloom.plans.discover import _check_landed, newest_landings, parse_pages, taken
from leadloom.schemas import LISTINGS, RunConfig, SourceConfig
from leadloom.session import stage
from leadloom.sources.boards import BOARDS, Board, select_sources
from leadloom.sources.state_table import StateTable

_CARD = [part.split() for part in LISTINGS.split(", ") if part.split()[0] not in ("source", "page_no", "pos")]
#: A page of a search: its number, when and in which batch it landed, and its cards in page order.
CRAWL_PAGES = (
    "page string, source string, page_no int, landed_at string, batch string, last boolean, cards array<struct<pos:int,"
    + ",".join(f"{name}:{kind}" for name, kind in _CARD)
    + ">>"
)


def crawl_table(spark: SparkSession, path: str, buckets: int | None = None) -> StateTable:
    """The pages of a crawl, kept between batches."""
    return StateTable(spark, path, CRAWL_PAGES, "page", buckets)


def page_rows(pages: DataFrame, config: RunConfig, batch: str, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """The visited pages of a batch as rows of the crawl table.

    A batch is few files, often of one row group each, and markup packs so well that a
    scan of them has hardly more tasks; pages are dealt before their cards are read.
    """
    chosen = select_sources(config)
    newest = stage(newest_landings(pages, chosen, boards), "landings")
    rows = parse_pages(pages, newest, chosen, boards, deal=True)
    names = [name for name, _ in _CARD]
    cards = rows.groupBy("source", "page_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), *names))).alias("cards"), F.max("last").alias("last")
    )
    none = F.array().cast(dict(cards.dtypes)["cards"])
    return newest.join(cards, ["source", "page_no"], "left").select(
        F.concat_ws("|", "source", "page_no").alias("page"),
        "source",
        "page_no",
        "landed_at",
        F.lit(batch).alias("batch"),
        F.coalesce("last", F.lit(False)).alias("last"),
        F.coalesce("cards", none).alias("cards"),
    )


def newer_pages(known: DataFrame, found: DataFrame) -> DataFrame:
    """The found pages that did not land before the stored ones; NULL is the oldest time."""
    old = known.select("page", F.lit(True).alias("__known"), F.col("landed_at").alias("__landed_at"))
    time = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = found.join(old, "page", "left")
    return both.where(F.col("__known").isNull() | (time("landed_at") >= time("__landed_at"))).select(*found.columns)


def _chosen_pages(pages: DataFrame, chosen: list[SourceConfig], boards: dict[str, Board]) -> DataFrame:
    """Stored pages of the chosen sources, with rank, cap and number of cards."""

    def by_source(value) -> Column:
        out = F.lit(None).cast("int")
        for i, config in enumerate(chosen, start=1):
            out = F.when(F.col("source") == config.source, F.lit(value(i, config))).otherwise(out)
        return out

    numbered = pages.withColumns(
        {"source_rank": by_source(lambda i, c: i), "cap": by_source(lambda i, c: c.max_listings), "n": F.size("cards")}
    )
    final = by_source(lambda i, c: max(c.max_listings, 1) if boards[c.source].paged else 1)
    return numbered.where(F.col("source_rank").isNotNull() & (F.col("page_no") <= final))


def crawled(pages: DataFrame, config: RunConfig, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Listings taken from the stored pages, each with the ``batch`` its page landed in."""
    counts = _chosen_pages(pages, select_sources(config), boards)
    kept = L.page_prefix(counts.drop("cards"), "cap", last="last")
    rows = counts.select("source", "source_rank", "page_no", "batch", F.inline("cards"))
    columns = [part.split()[0] for part in LISTINGS.split(", ")]
    return taken(rows, kept).select(*columns, "batch")


def new_listings(known: DataFrame, now: DataFrame, config: RunConfig, batch: str, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Listings a batch brings: those on its pages, and those it brought within reach.

    ``known`` are the pages before the batch and ``now`` those after it.
    """
    after = crawled(now, config, boards)
    before = crawled(known, config, boards).drop("batch")
    same = F.lit(True)
    for name in before.columns:
        same = same & after[name].eqNullSafe(before[name])
    untouched = after.where(F.col("batch") != batch).join(before, same, "left_anti")
    return after.where(F.col("batch") == batch).unionByName(untouched).drop("batch")


def check_crawl(table: StateTable, config: RunConfig, boards: dict[str, Board] = BOARDS) -> None:
    """Raise if a page the crawl would have asked for has not landed; for the end of a crawl."""
    chosen = select_sources(config)
    counts = stage(_chosen_pages(table.read(), chosen, boards).drop("cards"), "pages")
    _check_landed(counts, L.page_prefix(counts, "cap", last="last"), chosen, boards)
