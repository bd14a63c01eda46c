"""Streams of landed files folded into tables.

Keys are unbounded, so what was seen lives in a state table and not in the
state store.  Each micro-batch writes one change set under a tag made of the
stream's own id and the batch id; a replayed batch finds its tag and writes
nothing.  The id is kept with the checkpoint, so streams never share tags, and
one whose checkpoint was lost starts over under a new id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from leadloom.operators import state as S
from leadloom.operators.listing import collapse_last, dedupe_first
from leadloom.operators.summary import run_summary
from leadloom.plans.crawl import new_listings, newer_pages, page_rows
from leadloom.plans.run import Progress, ScorerFactory, process_listings
from leadloom.schemas import RunConfig
from leadloom.session import stage
from leadloom.sources.boards import BOARDS, Board
from leadloom.sources.state_table import StateTable


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder or glob; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that keeps its progress in ``checkpoint``."""
    place = f"{checkpoint.rstrip('/')}/stream-id"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(place)
    return spark.read.text(place).first()["value"]


def fold(
    stream: DataFrame,
    table: StateTable,
    changes: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    name: str = "fold",
) -> StreamingQuery:
    """Take in all available files.

    ``changes(known, batch)`` gives the changed rows; ``known`` are the stored
    rows of the batch's keys.
    """

    own = stream_id(stream.sparkSession, checkpoint)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            known = table.rows_of(batch)
            table.append_changes(changes(known, batch), f"{name}-{own}-{batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_listings(now: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes of a batch of listings: first row per key, then the discovered upsert."""

    def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
        order = [c for c in ("source_rank", "page_no", "pos") if c in batch.columns]
        unique = dedupe_first(batch, ["external_id"], order)
        return S.upsert_discovered(state, unique, now, how="right_outer")

    return changes


def first_seen(key: str, order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes of a first-wins dedupe: the first row of each key not stored yet."""

    def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
        unique = dedupe_first(batch.select(*state.columns), [key], order)
        return unique.join(state.select(key), key, "left_anti").select(*state.columns)

    return changes


def last_status(key: str, order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes of a status fold: the latest transition of each key in the batch."""

    def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
        newest = collapse_last(batch.select(*state.columns), [key], order)
        old = state.select(key, F.struct(*order).alias("__old"))
        return (
            newest.join(old, key, "left")
            .where(F.col("__old").isNull() | (F.struct(*order) > F.col("__old")))
            .select(*state.columns)
        )

    return changes


def run_stream(
    pages: DataFrame,
    config: RunConfig,
    crawl: StateTable,
    table: StateTable,
    offers: Callable[[], DataFrame],
    load_profile: Callable[[], DataFrame],
    make_scorer: ScorerFactory,
    now: Callable[[], str],
    checkpoint: str,
    on_summary: Callable[[int, dict], None] | None = None,
    boards: dict[str, Board] = BOARDS,
    progress: Progress | None = None,
) -> StreamingQuery:
    """Incremental runs: each micro-batch of landed pages is one run.

    A crawl may arrive in any number of batches and in any order: ``crawl`` (see
    ``plans.crawl.crawl_table``) keeps its pages, and a batch processes the
    listings it brings within reach.  Whether pages are still missing is asked
    with ``plans.crawl.check_crawl`` once the crawl has ended.  ``offers`` and
    ``now`` are called per batch.
    """

    own = stream_id(pages.sparkSession, checkpoint)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        tag = f"run-{own}-{batch_id}"
        known = crawl.read(before=tag)
        crawl.append_changes(newer_pages(known, page_rows(batch, config, tag, boards)), tag)
        listings = stage(new_listings(known, crawl.read(), config, tag, boards), "found")
        outcomes = process_listings(
            listings, table, offers(), load_profile, make_scorer, config.match_threshold, now(), tag, progress
        )
        if on_summary:
            on_summary(batch_id, run_summary(outcomes, table.read()).first().asDict())

    return (
        pages.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class ProgressListener(StreamingQueryListener):
    """Hands the counters of each finished micro-batch, observed metrics included, to a callback."""

    def __init__(self, report: Callable[[dict], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
        self.report({"batch": p.batchId, "rows": p.numInputRows, **observed})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
