"""From landed pages to the listings of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import listing as L
from leadloom.operators.keys import key_filter
from leadloom.schemas import LISTINGS, RunConfig, SourceConfig
from leadloom.session import stage
from leadloom.sources.boards import BOARDS, Board, Cards, read_cards, select_sources
from leadloom.sources.pages import landed_in, with_landing


def visited(pages: DataFrame, chosen: list[SourceConfig], boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Landed pages of the sources' searches, with ``source_rank`` and ``cap``.

    A landed page belongs to a search when its address is the one the search has
    for its number.  Pages behind number ``max_listings`` are never needed, as
    every page taken holds at least one listing.
    """
    number = F.col("page_no")
    wanted, rank, cap, base = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, config in enumerate(chosen, start=1):
        board, mine = boards[config.source], F.col("source") == config.source
        final = max(config.max_listings, 1) if board.paged else 1
        wanted = wanted | (mine & number.between(1, final) & (F.col("url") == board.search_url(config, number)))
        rank = F.when(mine, F.lit(i)).otherwise(rank)
        cap = F.when(mine, F.lit(config.max_listings)).otherwise(cap)
        base = F.when(mine, F.lit(config.base_url)).otherwise(base)
    return with_landing(pages).where(wanted).withColumns({"source_rank": rank, "cap": cap, "base_url": base})


def newest_landings(pages: DataFrame, chosen: list[SourceConfig], boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Each visited page once with its last landing, read from numbers and addresses only."""
    bare = with_landing(pages).select("source", "page_no", "url", "landed_at")
    found = visited(bare, chosen, boards).groupBy("source", "page_no")
    return found.agg(F.max("landed_at").alias("landed_at"), F.first("source_rank").alias("source_rank"), F.first("cap").alias("cap"))


def parse_pages(
    pages: DataFrame, newest: DataFrame, chosen: list[SourceConfig], boards: dict[str, Board] = BOARDS, deal: bool = False
) -> DataFrame:
    """Listings of the last landing of all visited pages, repeats on a page collapsed.

    The boards share one scan over the markup.  Older landings are dropped there
    by partition and by key; what the key filter lets through wrongly is dropped
    after its cards are read, so that markup is not shuffled.  With ``deal`` the
    wanted markup is shuffled once instead, for pages that lie in few files: cards
    are then read by as many tasks as other work has.
    """
    is_newest = key_filter(newest, ["source", "page_no", "landed_at"])
    markup = visited(pages, chosen, boards).where(landed_in(newest)).where(is_newest(F.col("source"), F.col("page_no"), F.col("landed_at")))
    last = F.lit(False)
    for config in chosen:
        more = boards[config.source].more
        if more:
            last = F.when(F.col("source") == config.source, ~F.col("html").rlike(more)).otherwise(last)
    markup = markup.select("source", "page_no", "url", "html", "base_url", "landed_at", "source_rank", last.alias("last"))
    if deal:
        tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        markup = markup.repartition(tasks, "source", "page_no")
    readers = {c.source: boards[c.source].read for c in chosen}
    shared = {s: r for s, r in readers.items() if isinstance(r, Cards)}
    parts = [read_cards(markup.where(F.col("source").isin(list(shared))), shared)] if shared else []
    parts += [read(markup.where(F.col("source") == s)) for s, read in readers.items() if s not in shared]
    # Cards are put together by page once; collapsing, counting and ranking on
    # a page then need no further shuffle.
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("source", "page_no")
    kept = newest.select(*(F.col(c).alias(f"__{c}") for c in ("source", "page_no", "landed_at")))
    same = (F.col("source") == F.col("__source")) & (F.col("page_no") == F.col("__page_no"))
    rows = rows.join(kept, same & F.col("landed_at").eqNullSafe(F.col("__landed_at")), "left_semi").drop("landed_at")
    return L.collapse_last_value(rows, ["source", "page_no", "external_id"], "pos")


def page_counts(newest: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per visited page: listings on it, whether it is the last, and the source's cap.

    Pages without listings end a crawl whatever their mark.
    """
    seen = newest.select("source", "page_no", "cap", "source_rank")
    n = rows.groupBy("source", "page_no").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
    return seen.join(n, ["source", "page_no"], "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "last": F.coalesce("last", F.lit(False))}
    )


def discover(
    pages: DataFrame,
    config: RunConfig,
    source: str | None = None,
    strict: bool = True,
    boards: dict[str, Board] = BOARDS,
) -> DataFrame:
    """Listings of a run, unique by key, the first source, page and card winning.

    Order of steps: collapse repeats on a page, follow the pages of a source,
    cap per source, union, dedupe.  The parsed rows are written once, since
    both the page counts and the result read them.  Of an address landed more
    than once the last landing counts.  A source whose next page was never
    landed fails the run; ``strict=False`` takes what there is instead.
    """
    chosen = select_sources(config, source)
    if not chosen:
        return pages.sparkSession.createDataFrame([], LISTINGS)
    newest = stage(newest_landings(pages, chosen, boards), "landings")
    rows = stage(parse_pages(pages, newest, chosen, boards), "listings")
    counts = stage(page_counts(newest, rows), "pages")
    kept = L.page_prefix(counts, "cap", last="last")
    if strict:
        _check_landed(counts, kept, chosen, boards)
    return taken(rows.drop("last"), kept).drop("source_rank")


def taken(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Listings of the pages a crawl takes, capped by source, unique by key."""
    capped = L.cap_rows(rows, kept, "cap").drop("rank")
    return L.dedupe_first(capped, ["external_id"], ["source_rank", "page_no", "pos"])


def _check_landed(counts: DataFrame, kept: DataFrame, chosen: list[SourceConfig], boards: dict[str, Board]) -> None:
    """Fail when a page the crawl would have asked for is missing.  At most one row per source is collected."""
    paged = F.col("source").isin([c.source for c in chosen if boards[c.source].paged])
    lost = L.unfinished(counts.where(paged), kept.where(paged), "cap", last="last")
    found = {r["source"] for r in counts.select("source").distinct().collect()}
    missing = {c.source for c in chosen} - found | {r["source"] for r in lost.collect()}
    if missing:
        raise RuntimeError(f"Request failed for a page of {', '.join(sorted(missing))}")
