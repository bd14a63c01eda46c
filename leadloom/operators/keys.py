"""A filter by many keys, applied where rows are scanned and before they move."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, as Spark's bitmap aggregate makes them.
BITMAP_BITS = 32_768
#: Bits a key, and bits in all: 2^28 are 32 MB, whatever the number of keys.
BITS_A_KEY, MOST_BITS = 64, 2**28


def key_filter(keys: DataFrame, columns: list[str]) -> Callable[..., Column]:
    """A predicate over as many values that holds for every key and for few other rows.

    A hashed bitmap of the keys enters the plan as a scalar subquery, so rows with
    long texts can be dropped in the task that scans them.  What passes wrongly
    (one in ``BITS_A_KEY``, more beyond ``MOST_BITS``) is left to the exact join
    behind it.  ``keys`` is read twice and should be a written table.  NULL is a
    value like others.
    """
    size = BITMAP_BITS
    wanted = keys.count() * BITS_A_KEY
    while size < min(wanted, MOST_BITS):
        size *= 2

    def place(*values: Column) -> Column:
        # hashes skip NULL, so each value says first whether it is one
        return F.pmod(F.xxhash64(*(v for value in values for v in (value.isNull(), value))), F.lit(size))

    at = place(*(F.col(c) for c in columns))
    maps = keys.select(at.alias("at")).select(F.floor(F.col("at") / BITMAP_BITS).alias("id"), (F.col("at") % BITMAP_BITS).alias("bit"))
    maps = maps.groupBy("id").agg(F.bitmap_construct_agg("bit").alias("bits"))
    every = keys.sparkSession.range(size // BITMAP_BITS).join(maps, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(b"")).alias("bits"))))
    bitmaps = every.agg(F.transform(ordered, lambda m: m["bits"]).alias("bits")).scalar()

    def holds(*values: Column) -> Column:
        bit = place(*values)
        inside = (bit % BITMAP_BITS).cast("int")
        byte = F.substring(F.get(bitmaps, F.floor(bit / BITMAP_BITS).cast("int")), F.floor(inside / 8).cast("int") + 1, F.lit(1))
        number = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.coalesce(F.getbit(number, inside % 8) == 1, F.lit(False))

    return holds
