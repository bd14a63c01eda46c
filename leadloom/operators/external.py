"""The external table: its catalog, its pages, and the plan of a sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.let import filled
from leadloom.functions.text import id_prefix, in_domain
from leadloom.operators.listing import collapse_last, dedupe_first
from leadloom.schemas import (
    JOB_COLUMNS,
    OPTIONAL_PROPERTIES,
    REQUIRED_PROPERTIES,
    SOURCES,
    STATUSES,
)


# --- catalog ---------------------------------------------------------------


def _expected(spark) -> DataFrame:
    rows = [(n, True, t) for n, t in REQUIRED_PROPERTIES.items()]
    rows += [(n, False, t) for n, t in OPTIONAL_PROPERTIES.items()]
    return spark.createDataFrame(rows, "name string, required boolean, allowed array<string>")


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """Properties that are missing or have a wrong type: ``name, type, message``."""
    both = _expected(catalog.sparkSession).join(catalog, "name", "left")
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    message = F.when(
        F.col("type").isNull() & F.col("required"),
        F.concat(F.lit("Missing required property: "), quoted),
    ).when(
        F.col("type").isNotNull() & ~F.array_contains(F.col("allowed"), F.col("type")),
        F.concat(
            F.when(F.col("required"), F.lit("Property ")).otherwise(F.lit("Optional property ")),
            quoted,
            F.lit(" must use one of: "),
            F.array_join("allowed", ", "),
        ),
    )
    return both.select("name", "type", message.alias("message")).where(F.col("message").isNotNull())


def property_kinds(catalog: DataFrame) -> dict[str, str]:
    """Type of each known property; raises on the first violation in declared order, the required ones first.

    At most one row per expected property reaches the driver.
    """
    known = list(REQUIRED_PROPERTIES) + list(OPTIONAL_PROPERTIES)
    declared = F.array_position(F.array(*(F.lit(n) for n in known)), F.col("name"))
    bad = catalog_violations(catalog).orderBy(declared).select("message").take(1)
    if bad:
        raise ValueError(bad[0]["message"])
    return {r["name"]: r["type"] for r in catalog.where(F.col("name").isin(known)).dropDuplicates(["name"]).collect()}


def page_catalog(pages: DataFrame) -> DataFrame:
    """Names and types of the properties seen on external pages."""
    return (
        pages.select(F.explode("properties").alias("name", "property"))
        .select("name", F.col("property.type").alias("type"))
        .distinct()
    )


# --- decoding pages --------------------------------------------------------


def joined_text(fragments: Column) -> Column:
    """Texts of a fragment list put together; NULL only when there is no list."""
    return F.array_join(F.transform(fragments, lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")


def _property(name: str) -> Column:
    return F.try_element_at(F.col("properties"), F.lit(name))


def _rich_text(name: str) -> Column:
    return joined_text(_property(name)["rich_text"])


def _option(name: str, kind: str) -> Column:
    return filled(_property(name)[kind]["name"])


def _date(name: str) -> Column:
    return filled(_property(name)["date"]["start"])


def decode_pages(pages: DataFrame, status_kind: str, source_kind: str | None = None, keep: list[str] = []) -> DataFrame:
    """Rebuild job rows from external pages; ``valid`` tells the usable ones.

    A page needs an id, a title, an address, a known status and a source, named
    by its property or by the prefix of its id.  An ``error`` of the scan stays.
    """
    external_id = _rich_text("External ID")
    if source_kind == "select":
        named = _option("Source", "select")
    elif source_kind == "rich_text":
        named = _rich_text("Source")
    else:
        named = F.lit(None).cast("string")
    errors = [F.col("error")] if "error" in pages.columns else []
    rows = pages.select(
        *keep,
        *errors,
        F.col("id").alias("page_id"),
        external_id.alias("external_id"),
        F.coalesce(in_domain(named, SOURCES), in_domain(id_prefix(external_id), SOURCES)).alias("source"),
        filled(_property("URL")["url"]).alias("url"),
        joined_text(_property("Name")["title"]).alias("title"),
        F.coalesce(_rich_text("Company"), F.lit("")).alias("company"),
        _rich_text("Salary").alias("salary_text"),
        _rich_text("Location").alias("location"),
        F.lit(None).cast("string").alias("offer_markdown"),
        _property("Match Score")["number"].alias("match_score"),
        _rich_text("Match Reason").alias("match_reason"),
        _rich_text("Summary").alias("summary"),
        in_domain(_option("Status", "status" if status_kind == "status" else "select"), STATUSES).alias("status"),
        F.coalesce(_date("Created At"), _rich_text("Created At"), F.col("created_time"), F.lit("")).alias("created_at"),
        F.coalesce(_date("Updated At"), _rich_text("Updated At"), F.col("last_edited_time"), F.lit("")).alias("updated_at"),
    )
    valid = (
        (F.col("external_id") != "")
        & (F.col("title") != "")
        & F.col("url").isNotNull()
        & F.col("source").isNotNull()
        & F.col("status").isNotNull()
    )
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def import_rows(decoded: DataFrame, order: list[str]) -> DataFrame:
    """Usable rows of an import, the last page of a key winning."""
    usable = decoded.where("valid").select(*JOB_COLUMNS, *order)
    return collapse_last(usable, ["external_id"], order).select(*JOB_COLUMNS)


def external_index(pages: DataFrame, order: list[str]) -> DataFrame:
    """Key, page and synced time of each page; the first page of a key counts."""
    rows = pages.select(
        _rich_text("External ID").alias("external_id"),
        F.col("id").alias("page_id"),
        F.coalesce(_rich_text("Updated At"), _date("Updated At")).alias("synced_updated_at"),
        *order,
    ).where(F.col("external_id").isNotNull())
    return dedupe_first(rows, ["external_id"], order).drop(*order)


# --- building pages --------------------------------------------------------


def _fragments(value: Column) -> Column:
    item = F.struct(F.lit("text").alias("type"), F.struct(value.alias("content")).alias("text"))
    none = F.array().cast("array<struct<type:string,text:struct<content:string>>>")
    return F.when(value.isNotNull() & (value != ""), F.array(item)).otherwise(none)


def _as(kind: str, value: Column) -> Column:
    if kind in ("title", "rich_text"):
        return F.struct(_fragments(value).alias(kind))
    if kind in ("status", "select"):
        return F.struct(F.struct(value.alias("name")).alias(kind))
    if kind == "date":
        return F.struct(F.struct(value.alias("start")).alias(kind))
    return F.struct(value.alias(kind))


# Property name and job column, in the order they are written.
PROPERTY_COLUMNS = {
    "Name": "title",
    "External ID": "external_id",
    "URL": "url",
    "Status": "status",
    "Source": "source",
    "Company": "company",
    "Salary": "salary_text",
    "Location": "location",
    "Match Score": "match_score",
    "Match Reason": "match_reason",
    "Summary": "summary",
    "Created At": "created_at",
    "Updated At": "updated_at",
}


def build_properties(kinds: dict[str, str]) -> Column:
    """External page properties of a job row as JSON.

    A property the target lacks is left out; an empty text clears its list and
    a missing score is written as null.
    """
    fields = [
        _as(kinds[name], F.col(column)).alias(name)
        for name, column in PROPERTY_COLUMNS.items()
        if name in kinds
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


# --- sync ------------------------------------------------------------------


def sync_plan(jobs: DataFrame, index: DataFrame, key: str = "external_id", version: str = "updated_at") -> DataFrame:
    """Add ``page_id`` and ``action``: create, update, or skip when the synced
    version is the stored one.  ``index`` is unique by key."""
    joined = jobs.join(index.select(key, "page_id", "synced_updated_at"), key, "left")
    action = (
        F.when(F.col("page_id").isNull(), F.lit("create"))
        .when(F.col("synced_updated_at") == F.col(version), F.lit("skip"))
        .otherwise(F.lit("update"))
    )
    return joined.select(*jobs.columns, "page_id", action.alias("action"))


def change_set(plan: DataFrame, kinds: dict[str, str], key: str = "external_id") -> DataFrame:
    """``action, page_id, external_id, properties_json``; rows to skip have no properties."""
    properties = F.when(F.col("action") != "skip", build_properties(kinds))
    return plan.select("action", "page_id", key, properties.alias("properties_json"))
