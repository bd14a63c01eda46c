"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies each of its documents gets.  A
document's number of copies is the inverse of the Poisson distribution with that
mean at a number in [0, 1) hashed from the seed and the document's id, so it is
the same in every run and needs no other document.  Copies are then dealt out by
a hash of id and copy, and sorted by it: a repeatable global shuffle.

The size of a source is its number of characters.  Null sources form one source;
a source without any text has rate 1.  Documents without an id are told apart by
their text; repeated rows get the same number of copies each.  Null and empty
texts are replicated like others.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import Staged, bounded, free_names, uniform

#: Beyond this mean number of copies an explicit weight is taken for a mistake.
MAX_RATE = 1000.0
#: Sources up to which the rates are broadcast (a few hundred bytes each).
MAX_SOURCES = 10_000


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies, until what is left is below 1e-15."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.array(F.exp(-rate)).alias("below"), (-rate).alias("log"))

    def step(at: Column, k: Column) -> Column:
        log = at["log"] + F.log(rate) - F.log(k)
        return F.struct(F.concat(at["below"], F.array(F.element_at(at["below"], -1) + F.exp(log))).alias("below"), log.alias("log"))

    table = F.aggregate(F.sequence(F.lit(1), most), start, step)["below"]
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """``source``, ``rate`` and its ``table``.

    The shares of the sources are ``weights`` (missing ones count 0) or else
    proportional to their size to the power of ``exponent``; the output has
    ``epochs`` times the characters of the input.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.coalesce(F.try_divide("weight", "all_weight"), F.lit(0.0))
    rate = F.when(F.col("size") > 0, F.lit(epochs) * share * F.col("all_size") / F.col("size")).otherwise(F.lit(1.0))
    if weights is not None:
        rate = F.when(rate > MAX_RATE, F.raise_error(F.lit(f"a source would be repeated more than {MAX_RATE:.0f} times"))).otherwise(rate)
    # one row of two sums beside each source
    return sizes.join(F.broadcast(total)).select("source", rate.alias("rate")).withColumn("table", poisson_table(F.col("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """The documents, replicated to the target shares and shuffled.

    A last column, ``copy`` (with underscores after it if there is such a column
    already, in any case), counts the copies from 1.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    number, from_, chances, place, times, order = free_names(docs, "copy", "__source", "__table", "__at", "__n", "__order")
    table = bounded(rates(docs, weights, exponent, epochs), Staged(docs.sparkSession, "mix"), MAX_SOURCES)
    table = table.select(F.col("source").alias(from_), F.col("table").alias(chances))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.join(table, F.col("source").eqNullSafe(F.col(from_)))
    rows = rows.withColumn(place, uniform(F.lit(seed), key))
    rows = rows.withColumn(times, F.size(F.filter(chances, lambda below: below <= F.col(place))))
    copies = rows.where(F.col(times) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(times))).alias(number))
    dealt = copies.withColumn(order, F.xxhash64(F.lit(seed), key, F.col(number)))
    return dealt.repartition(order).sortWithinPartitions(order).drop(order)


ORACLE_SQL = """
WITH sizes AS (
    SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source
), weighed AS (
    SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0 END AS weight FROM sizes
), rated AS (
    SELECT source,
           CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size) FROM weighed) / size ELSE 1 END AS rate
    FROM weighed
), chances AS (
    SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
    FROM rated, generate_series(0, 60) AS s(k)
), placed AS (
    SELECT doc_id, text, lang, source, n_chars,
           CAST('0x' || substr(md5('mix|' || doc_id), 1, 13) AS BIGINT) / pow(2, 52) AS u
    FROM documents
), counted AS (
    SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars, count(*) AS n
    FROM placed p JOIN chances c ON c.source = p.source AND c.below <= p.u
    GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM counted
"""
