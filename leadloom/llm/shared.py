"""Helpers the corpus operators share."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.session import work_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

#: Texts that one Python step holds at a time.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 500


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so further columns of ``df`` cannot clash with working names."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores behind it until no column of ``df`` reads the same in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(1, batch.column(text).nbytes)))
        at = 0
        while at < n:
            part = batch.slice(at, step)
            while part.num_rows > 1 and _bytes(part.column(text)) > 2 * limit:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def _bytes(column: pa.Array) -> int:
    if pa.types.is_list(column.type):
        return 4 * (pc.sum(pc.list_value_length(column)).as_py() or 0)
    return pc.sum(pc.binary_length(column)).as_py() or 0


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH_ROWS`` rows: the default of 10,000 long texts would not fit a small executor."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(run, schema)


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the md5 of ``parts``: 52 bits, the same in any engine."""
    key = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


class Staged:
    """Results written below the shared folder; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.base = work_folder(spark, purpose)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, staged: Staged, rows: int) -> DataFrame:
    """``df``, written once, with a broadcast hint only if it has at most ``rows`` rows."""
    written, _ = staged.write(df)
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows, at most twice as many, chosen by a hash of ``key``; what tasks return stays in proportion to ``size``."""
    total = max(1, rows.count())
    at = uniform(F.lit("sample"), F.col(key).cast("string"))
    return rows.where(at < min(1.0, 1.5 * size / total)).orderBy(at, key).limit(2 * size)


def pack(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the compressed ``text`` of documents that have an id."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, packed binary, n_bytes long"

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text"):
            data = [(t or "").encode() for t in part.column("text").to_pylist()]
            columns = [part.column(0), pa.array([squeeze.compress(d) for d in data], pa.binary()), pa.array([len(d) for d in data], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "packed", "n_bytes"])

    return in_arrow(take(docs, "doc_id", "text").where("doc_id is not null"), run, schema)


def unpacked(batches):
    """Batches in slices of bounded unpacked size, each with its texts."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes = batch.column("n_bytes").to_numpy()
        group = np.cumsum(sizes) // SLICE_BYTES
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(sizes) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            yield part, [expand.decompress(d).decode() if d else "" for d in part.column("packed").to_pylist()]
