"""Changes to the keyed job table, as joins on its key.

Every function takes the state rows and the change rows, both unique by key,
and returns the new rows; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.schemas import JOB_COLUMNS, LISTING_COLUMNS, TERMINAL


def status_lookup(rows: DataFrame, state: DataFrame, key: str = "external_id") -> DataFrame:
    """Add the stored status; NULL for a key never seen."""
    return rows.join(state.select(key, "status"), key, "left")


def needs_work(status: Column) -> Column:
    """Anything but a terminal status is processed (again)."""
    return status.isNull() | ~status.isin(TERMINAL)


def incremental_skip(rows: DataFrame, state: DataFrame, key: str = "external_id") -> DataFrame:
    """Rows whose key is not in a terminal status."""
    done = state.where(F.col("status").isin(TERMINAL)).select(key)
    return rows.join(done, key, "left_anti")


def known_rows(rows: DataFrame, state: DataFrame, key: str = "external_id") -> DataFrame:
    """Rows whose key is stored."""
    return rows.join(state.select(key), key, "left_semi")


def upsert_discovered(
    state: DataFrame,
    incoming: DataFrame,
    now: str,
    key: str = "external_id",
    tracked: list[str] = LISTING_COLUMNS,
    how: str = "full_outer",
) -> DataFrame:
    """Insert new keys as ``discovered``; refresh the tracked columns of known ones.

    ``updated_at`` moves only when a tracked column differs, NULL counting as a
    value.  All other columns of a known row stay.  With ``how="right_outer"``
    only incoming rows that are new or differ come back (a change set).
    """
    new = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in tracked], F.lit(True).alias("__in"))
    both = state.withColumn("__known", F.lit(True)).join(new, key, how)
    seen = F.col("__in").isNotNull()
    inserted = F.col("__known").isNull()
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    if how == "right_outer":
        both = both.where(inserted | ~same)
    values: dict[str, Column] = {c: F.when(seen, F.col(f"__new_{c}")).otherwise(F.col(c)) for c in tracked}
    values["status"] = F.when(inserted, F.lit("discovered")).otherwise(F.col("status"))
    values["created_at"] = F.when(inserted, F.lit(now)).otherwise(F.col("created_at"))
    values["updated_at"] = F.when(inserted | (seen & ~same), F.lit(now)).otherwise(F.col("updated_at"))
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in state.columns])


def upsert_replace(state: DataFrame, incoming: DataFrame, key: str = "external_id") -> DataFrame:
    """Replace whole rows by key, NULLs and times included; keep the others."""
    columns = [c for c in state.columns if c != key]
    new = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__in"))
    return state.join(new, key, "full_outer").select(
        *[
            F.col(c)
            if c == key
            else F.when(F.col("__in").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
            for c in state.columns
        ]
    )


def apply_updates(
    state: DataFrame, updates: DataFrame, now: str, key: str = "external_id", how: str = "left"
) -> DataFrame:
    """Keyed updates: a status change, a fetched document, or a score.

    A column the update leaves NULL keeps its stored value; ``updated_at``
    always moves; an update for an unknown key does nothing.  With
    ``how="inner"`` only updated rows come back (a change set).
    """
    carried = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in carried], F.lit(True).alias("__in"))
    values = {c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in carried}
    values["updated_at"] = F.when(F.col("__in").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    return state.join(new, key, how).select(
        *[values.get(c, F.col(c)).alias(c) for c in state.columns]
    )


def latest_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Fold successive status writes: the last one remains."""
    return events.groupBy(key).agg(F.max_by(F.col(status), F.struct(*order)).alias(status))


def empty_state(spark) -> DataFrame:
    from leadloom.schemas import JOBS

    return spark.createDataFrame([], JOBS).select(*JOB_COLUMNS)
