"""Reading landed page batches of the external table and sending changes to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.permits import permit
from leadloom.schemas import CATALOG, EXTERNAL_PAGE


def explode_batches(batches: DataFrame, order: str) -> DataFrame:
    """One row per page with ``batch_no`` and ``pos``; missing times become ''.

    ``results`` holds pages, or their JSON texts, which are then read one by one.
    ``error`` tells what could not be read: a batch without a list of pages is one
    row, and so is a list entry that is no page.
    """
    # told before the list is taken apart: a list named behind that would be copied to each of its pages
    told = batches.select(F.col(order).alias("batch_no"), F.col("results").isNull().alias("__lost"), "results")
    rows = told.select("batch_no", "__lost", F.posexplode_outer("results").alias("pos", "page"))
    # an empty list is a batch without pages, not an error
    rows = rows.where(F.col("__lost") | F.col("pos").isNotNull())
    if dict(rows.dtypes)["page"] == "string":
        rows = rows.withColumn("page", F.from_json("page", EXTERNAL_PAGE))
    broken = F.when(F.col("__lost"), F.lit("batch is not readable")).when(F.col("page.id").isNull(), F.lit("entry is not a page"))
    return (
        rows.select("batch_no", F.coalesce("pos", F.lit(0)).alias("pos"), "page.*", broken.alias("error"))
        .withColumn("created_time", F.coalesce("created_time", F.lit("")))
        .withColumn("last_edited_time", F.coalesce("last_edited_time", F.lit("")))
    )


def read_page_batches(spark: SparkSession, path: str) -> DataFrame:
    """Pages of landed batch files, in UTF-8, below ``path``; files are ordered by their path.

    A file that is no JSON, or was cut off, is one row with an ``error``; its
    pages are read one by one, so that a broken one does not take others with it.
    A file may hold one batch or a list of them.

    Files are read as texts and parsed from memory: for every page it takes as text
    the JSON source goes through its file anew, so that its time grows with the
    square of a file.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    whole = files.select(F.col("_metadata.file_path").alias("__file"), F.regexp_replace("value", "\\A\ufeff", "").alias("value"))
    read = whole.select("__file", F.from_json("value", "array<struct<results:array<string>>>").alias("batches"))
    batches = read.where(F.coalesce(F.size("batches") != 0, F.lit(True))).select("__file", F.explode_outer("batches").alias("batch"))
    return explode_batches(batches.select("__file", "batch.results"), "__file")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).json(path)


def write_changes(changes: DataFrame, path: str) -> None:
    """Write a change set, one folder per action."""
    changes.write.mode("overwrite").partitionBy("action").json(path)


#: Called with action, page id, properties as JSON, and the key of the row.
Sender = Callable[[str, "str | None", str, str], None]
#: Asked for the page id of a key, None if the target has no such page.
Lookup = Callable[[str], "str | None"]


def send_changes(changes: DataFrame, send: Sender, parallelism: int | None = None, lookup: Lookup | None = None) -> DataFrame:
    """Hand each change to ``send(action, page_id, properties_json, external_id)``.

    Returns ``external_id, action, error``; a raising call only marks its row.
    A task that runs again calls ``send`` again.  With ``lookup`` the target is
    asked before a page is created, and one that exists already is updated; without,
    the target must tell repeats by the key.  ``parallelism`` bounds the
    calls that an executor makes at the same time.
    """

    rows = changes.select("external_id", "action", "page_id", "properties_json")
    return rows.mapInPandas(_sending(send, parallelism, lookup), "external_id string, action string, error string")


def _sending(send: Sender, parallelism: int | None, lookup: Lookup | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with its changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for key, action, page_id, properties in zip(
                batch["external_id"], batch["action"], batch["page_id"], batch["properties_json"]
            ):
                try:
                    found = lookup(key) if lookup and action == "create" else None
                    how, at = ("update", found) if found is not None else (action, page_id)
                    with permit("send", parallelism):
                        send(how, at, properties, key)
                    errors.append(None)
                except Exception as problem:  # one bad row must not stop the others
                    errors.append(str(problem) or type(problem).__name__)
            yield pd.DataFrame(
                {"external_id": batch["external_id"], "action": batch["action"], "error": errors}
            )

    return run
