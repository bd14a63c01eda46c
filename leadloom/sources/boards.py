"""The listing boards: search addresses, card readers and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions import markup as M
from leadloom.functions import urls as U
from leadloom.functions.let import bind, let
from leadloom.functions.text import has_currency, is_label, is_undisclosed
from leadloom.schemas import RunConfig, SourceConfig

FIELDS = ["title", "company", "salary_text", "location"]
#: Markup that a task holds as Python texts at a time.
SLICE_BYTES = 4 << 20


def cards(pages: DataFrame, wanted: Callable[[Column], Column], html: str = "html") -> DataFrame:
    """One row per anchor of a page whose ``href`` is wanted, with its place on the page."""
    keep = [c for c in pages.columns if c != html]
    found = H.anchors(H.strip_silent(F.col(html)))
    return (
        pages.select(*keep, F.posexplode(found).alias("pos", "card"))
        .withColumn("href", H.attribute(F.col("card"), "href"))
        .where(wanted(F.col("href")))
    )


def ordered_fields(leaves: Column) -> Column:
    """Title, company and place are the first three texts that are neither label nor salary.

    The salary is the first disclosed salary text behind the title and before the
    place.
    """
    marked = F.transform(
        leaves,
        lambda x, i: F.struct(
            x["text"].alias("text"),
            i.alias("i"),
            has_currency(x["text"]).alias("paid"),
            is_label(x["text"]).alias("label"),
        ),
    )

    def fields(texts: Column, plain: Column) -> Column:
        title, company, place = (F.get(plain, F.lit(i)) for i in range(3))
        salary = F.filter(
            texts,
            lambda x: x["paid"]
            & ~is_undisclosed(x["text"])
            & (x["i"] > title["i"])
            & (place["i"].isNull() | (x["i"] < place["i"])),
        )
        return _struct(title["text"], company["text"], F.get(salary, F.lit(0))["text"], place["text"])

    return let(
        marked,
        lambda texts: let(F.filter(texts, lambda x: ~x["label"] & ~x["paid"]), lambda plain: fields(texts, plain)),
    )


def _struct(title: Column, company: Column, salary: Column, place: Column) -> Column:
    return F.struct(title.alias("title"), company.alias("company"), salary.alias("salary_text"), place.alias("location"))


def with_ordered_fields(df: DataFrame, leaves: str = "leaves") -> DataFrame:
    """Add the fields read by order from a column of leaf texts."""
    return bind(df, F.col(leaves), ordered_fields)


@dataclass(frozen=True)
class Cards:
    """How the cards of a board are told and read.

    ``wanted`` tells a card by its ``href``, and ``path``, where given, by the
    path of its resolved address.  ``fields`` reads the fields from a card.
    ``absolute`` keeps absolute addresses as they are.
    """

    wanted: Callable[[str], bool]
    fields: Callable[[M.Card], M.Fields]
    path: str | None = None
    absolute: bool = False

    def listings(self, html: str, base_url: str) -> list[tuple]:
        """Place, ``href``, address, path and fields of the cards of a page."""
        out = []
        for pos, card, href in M.anchors(html):
            if href is None or not self.wanted(href):
                continue
            if self.absolute and href.startswith(("http://", "https://")):
                url = href
            else:
                url = M.resolved(href, base_url)
            path = M.pathname(url)
            if self.path is None or re.search(self.path, path):
                out.append((pos, href, url, path, *self.fields(M.Card(card))))
        return out


FLAT = Cards(lambda href: "/job-offer/" in href, M.flat_fields, absolute=True)
HEADED = Cards(lambda href: href.startswith("/pl/job/"), M.headed_fields)
BLOCKS = Cards(lambda href: "/companies/jobs/" in href, M.block_fields, r"\A/companies/jobs/[0-9]")


def read_cards(pages: DataFrame, readers: dict[str, Cards]) -> DataFrame:
    """Listings of the pages of several boards, from one scan over their markup.

    ``pages`` carry ``source`` and ``base_url``.  Columns beyond those of a page
    (``last``, ``landed_at``) stay with the listings.  Cards are cut and read in the
    task that scans their page; only what a listing holds leaves it.
    """
    kept = [c for c in pages.columns if c not in ("html", "url")]
    new = [F.lit(None).cast("int").alias("pos"), *(F.lit(None).cast("string").alias(c) for c in ("href", "url", "path", *FIELDS))]
    schema = pages.select(*kept, *new).schema
    names = schema.names[len(kept) :]

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                at, rows = [], []
                pages_of = zip(*(part.column(c).to_pylist() for c in ("source", "base_url", "html")), strict=True)
                for i, (source, base, html) in enumerate(pages_of):
                    if html is not None and source in readers:
                        found = readers[source].listings(html, base)
                        rows += found
                        at += [i] * len(found)
                same = part.select(kept).take(pa.array(at, pa.int64()))
                columns = [pa.array([r[k] for r in rows], pa.int32() if name == "pos" else pa.string()) for k, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*same.columns, *columns], [*kept, *names])

    return to_listings(pages.mapInArrow(run, schema))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE_BYTES`` of markup, one page at least."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column("html").nbytes))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def with_address(df: DataFrame, keep_absolute: Column | None = None) -> DataFrame:
    """Set the card's ``url`` and its ``path``, resolved against ``base_url``; absolute ones may be kept as they are."""
    href = F.col("href")
    url = U.resolve(href, F.col("base_url"))
    if keep_absolute is not None:
        url = F.when(keep_absolute & href.rlike(r"\Ahttps?://"), href).otherwise(url)
    keep = [c for c in df.columns if c != "url"]
    return bind(df, url, lambda u: F.struct(u.alias("url"), U.pathname(u).alias("path")), keep)


_LISTING_INPUTS = {"source", "url", *FIELDS, "page_no", "pos", "href", "base_url", "path"}


def to_listings(df: DataFrame) -> DataFrame:
    """Give each card its identity; cards without title or company are dropped.

    What else a page carries stays with its listings.
    """
    return df.where(F.col("title").isNotNull() & F.col("company").isNotNull()).select(
        F.concat(F.col("source"), F.lit(":"), F.col("path")).alias("external_id"),
        "source",
        "url",
        *FIELDS,
        "page_no",
        "pos",
        *[c for c in df.columns if c not in _LISTING_INPUTS],
    )


@dataclass(frozen=True)
class Board:
    """How to search a board and read its pages.

    ``read`` says how its cards are read; such boards share one scan.  It may
    also be a function from pages with their ``base_url`` to listings, which then
    scans the board's pages for itself and keeps what else a page carries.  With ``more`` a page without that
    pattern is the last one.
    """

    search_url: Callable[[SourceConfig, Column], Column]
    read: Cards | Callable[[DataFrame], DataFrame]
    paged: bool = True
    more: str | None = None


def _text(filters: dict, name: str) -> Column:
    return F.lit(filters.get(name)).cast("string")


def _query_url(config: SourceConfig, page_no: Column) -> Column:
    f = config.filters
    return U.query_search_url(
        F.lit(config.base_url),
        _text(f, "keyword"),
        _text(f, "category"),
        _text(f, "location"),
        _text(f, "working_mode"),
        _text(f, "experience_level"),
        F.lit(f.get("min_salary")).cast("double"),
        _text(f, "salary_currency"),
        F.lit(bool(f.get("with_salary"))),
    )


def _path_url(config: SourceConfig, page_no: Column) -> Column:
    f = config.filters
    return U.path_search_url(F.lit(config.base_url), _text(f, "location"), _text(f, "keyword"), page_no)


def _comma_url(config: SourceConfig, page_no: Column) -> Column:
    return U.comma_search_url(F.lit(config.base_url), _text(config.filters, "keyword"), page_no)


# The boards by source name; add an entry to read another one.
BOARDS: dict[str, Board] = {
    "justjoinit": Board(_query_url, FLAT, paged=False),
    "nofluffjobs": Board(_path_url, HEADED, more="(?i)nfjloadmore|pokaż kolejne oferty"),
    "bulldogjob": Board(_comma_url, BLOCKS),
}


def select_sources(config: RunConfig, source: str | None = None) -> list[SourceConfig]:
    """Enabled sources in declared order, or the one asked for."""
    if source is None:
        return [s for s in config.sources if s.enabled]
    chosen = [s for s in config.sources if s.source == source]
    if not chosen:
        raise ValueError(f'Source "{source}" is not configured')
    if not chosen[0].enabled:
        raise ValueError(f'Source "{source}" is disabled in config')
    return chosen


def frontier(spark: SparkSession, config: SourceConfig, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Addresses a source may be asked for: ``source, page_no, url, base_url``.

    A page taken holds at least one listing, so pages behind number
    ``max_listings`` are never needed.
    """
    board = boards[config.source]
    pages = max(config.max_listings, 1) if board.paged else 1
    numbers = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page_no"))
    return numbers.select(
        F.lit(config.source).alias("source"),
        "page_no",
        board.search_url(config, F.col("page_no")).alias("url"),
        F.lit(config.base_url).alias("base_url"),
    )
