"""From cards on many pages to one row per listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pages per block of a running count.  A window never holds more than this many
# pages of a group, however many pages the group has.
BLOCK = 10_000


def union_sources(parts: list[DataFrame], rank: str = "source_rank") -> DataFrame:
    """Union in declared order; the order is kept as a rank column."""
    ranked = [df.withColumn(rank, F.lit(i)) for i, df in enumerate(parts, start=1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def _rest(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key.

    An aggregate, so each task reduces its rows to one per key before the
    shuffle and a hot key costs no more than any other.
    """
    first = F.min_by(_rest(df, keys), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, "__row.*").select(*df.columns)


def collapse_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key."""
    last = F.max_by(_rest(df, keys), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, "__row.*").select(*df.columns)


def collapse_last_value(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row per key: the position of the first, the values of the last."""
    rest = F.struct(*[c for c in df.columns if c not in keys and c != pos])
    return (
        df.groupBy(*keys)
        .agg(F.min(pos).alias(pos), F.max_by(rest, F.col(pos)).alias("__row"))
        .select(*keys, pos, "__row.*")
        .select(*df.columns)
    )


def page_prefix(
    pages: DataFrame,
    cap: int | str,
    group: str = "source",
    page_no: str = "page_no",
    n: str = "n",
    last: str | None = None,
) -> DataFrame:
    """Pages a crawl of each group would have taken, with the rows taken before each.

    ``pages`` has one row per group and page.  Taking stops before a page
    without rows, before a missing page, behind a page flagged ``last`` and as
    soon as ``cap`` rows (a number or a column) are there.  Every page taken
    has at least one row, so no page behind number ``cap`` can be taken: that
    filter bounds the running count, and block totals bound each window.
    """
    limit = F.lit(cap) if isinstance(cap, int) else F.col(cap)
    final = F.min(F.when(F.col(last), F.col(page_no))) if last else F.lit(None).cast("long")
    bounds = pages.groupBy(group).agg(
        F.min(F.when(F.col(n) == 0, F.col(page_no))).alias("__stop"), final.alias("__final")
    )
    usable = (
        pages.where(F.col(page_no) <= limit)
        .join(bounds, group)
        .where(F.col("__stop").isNull() | (F.col(page_no) < F.col("__stop")))
        .where(F.col("__final").isNull() | (F.col(page_no) <= F.col("__final")))
        .drop("__stop", "__final")
        .withColumn("__block", F.floor((F.col(page_no) - 1) / BLOCK))
    )

    def running(value: Column, *by: str, order: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(value.over(w), F.lit(0)).cast("long")

    counted = usable.withColumns(
        {
            "before": running(F.sum(n), group, "__block", order=page_no),
            "__seen": running(F.count(F.lit(1)), group, "__block", order=page_no),
        }
    )
    blocks = usable.groupBy(group, "__block").agg(F.sum(n).alias("__n"), F.count(F.lit(1)).alias("__pages"))
    offsets = blocks.select(
        group,
        "__block",
        running(F.sum("__n"), group, order="__block").alias("__n_before"),
        running(F.sum("__pages"), group, order="__block").alias("__pages_before"),
    )
    counted = counted.join(offsets, [group, "__block"]).withColumns(
        {
            "before": F.col("before") + F.col("__n_before"),
            "__seen": F.col("__seen") + F.col("__pages_before"),
        }
    )
    return counted.where((F.col("before") < limit) & (F.col("__seen") == F.col(page_no) - 1)).select(
        *pages.columns, "before"
    )


def cap_rows(
    rows: DataFrame,
    kept: DataFrame,
    cap: int | str,
    group: str = "source",
    page_no: str = "page_no",
    pos: str = "pos",
) -> DataFrame:
    """First ``cap`` rows per group in page and card order.

    A row's rank is the running count of its page plus its place on the page,
    so only the rows of one page are ever ordered together.
    """
    limit = F.lit(cap) if isinstance(cap, int) else F.col(cap)
    extra = [cap] if isinstance(cap, str) and cap not in rows.columns else []
    on_page = F.row_number().over(Window.partitionBy(group, page_no).orderBy(pos))
    return (
        rows.join(kept.select(group, page_no, "before", *extra), [group, page_no])
        .withColumn("rank", F.col("before") + on_page)
        .where(F.col("rank") <= limit)
        .select(*rows.columns, "rank")
    )


def unfinished(pages: DataFrame, kept: DataFrame, cap: int | str, group: str = "source", n: str = "n",
               page_no: str = "page_no", last: str | None = None) -> DataFrame:
    """Groups whose crawl ended only because the next page was never landed."""
    limit = F.lit(cap) if isinstance(cap, int) else F.max(cap)
    done = F.max(F.col(last).cast("int")) if last else F.lit(0)
    taken = kept.groupBy(group).agg(
        F.max(page_no).alias("taken"),
        F.sum(n).alias("rows"),
        F.coalesce(done, F.lit(0)).alias("done"),
        limit.alias("cap"),
    )
    empty = pages.where(F.col(n) == 0).select(group, (F.col(page_no) - 1).alias("taken")).distinct()
    return (
        taken.where((F.col("done") == 0) & (F.col("rows") < F.col("cap")))
        .join(empty, [group, "taken"], "left_anti")
        .select(group, (F.col("taken") + 1).alias("missing_page"))
    )
