"""Bind a value once inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(text: Column) -> Column:
    """``text``, or NULL when it is empty; unlike ``nullif`` it computes ``text`` once."""
    return F.get(F.filter(F.array(text), lambda v: v != F.lit("")), F.lit(0))


def bind(df: DataFrame, value: Column, fields: Callable[[Column], Column], keep: list[str] | None = None) -> DataFrame:
    """Add the fields of the struct ``fields(value)`` to each row.

    ``value`` is computed once per row.  A plain projection would not promise
    that: stacked projections may be merged, and an array named inside a lambda
    would then be rebuilt for every element.
    """
    keep = df.columns if keep is None else keep
    return df.select(*keep, F.inline(F.transform(F.array(value), fields)))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column ``build`` gives for hashable arguments.

    A large expression takes thousands of calls to the JVM to put together, some
    seconds in all; the column itself belongs to no plan and can be used in many.
    """
    made: dict[tuple, Column] = {}

    @wraps(build)
    def column(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return column
