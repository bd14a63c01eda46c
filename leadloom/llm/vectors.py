"""Near-duplicate vectors by product quantisation.

1. Vectors that are equal bit for bit are one class; its least id goes on, with
   the size of the class as its weight.
2. A coarse quantiser and codebooks of the residuals are fitted on the driver on
   a bounded sample.  Every vector is indexed in the list of its nearest coarse
   centre by its residual codes, and asks the ``PROBES`` lists nearest to it.
3. Lists are worked on in blocks of bounded size, so a list may be of any length.
   A query's tables of inner products with the codewords give approximate
   cosines; with the quantisation error of the indexed vector added they bound
   the true ones, so nothing a probe reaches is dismissed wrongly.  What may reach
   the threshold is compared exactly, in double precision.
4. Blocks return counts and the least id of each local component, one row per
   vector: links are counted, never listed.  A pair counts once for each side:
   if both vectors ask for each other's list each counts the other, else the one
   that asks counts for both.

Vectors that are null, zero, or hold null or non-finite components link with
nothing.  Shorter vectors are filled up with zeros.  Rows without an id link with
nothing.  Rows of one id and one vector are one vector each for the counts of
others.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.components import components
from leadloom.llm.shared import Staged, in_arrow, sample, take

SIMILAR = 0.9
PROBES = 12
LIST_LENGTH, MAX_LISTS = 512, 2048
SAMPLE_PER_LIST, MIN_SAMPLE = 16, 4096
SUBSPACES, CODES = 16, 64
BLOCK_INDEXED, BLOCK_ASKING = 1024, 2048
ROWS_AT_ONCE = 1 << 15
#: Sampled rows whose distances to all centres are held at a time while fitting.
FIT_ROWS = 2048


@dataclass
class Model:
    """Coarse centres (k, d) and codebooks (SUBSPACES, CODES, d / SUBSPACES) of unit vectors."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        length, n = (self.centres**2).sum(1), min(n, len(self.centres))
        out = np.empty((len(x), n), np.int64)
        for k in range(0, len(x), FIT_ROWS):
            near = length - 2 * x[k : k + FIT_ROWS] @ self.centres.T
            some = np.argpartition(near, n - 1, axis=1)[:, :n]
            out[k : k + FIT_ROWS] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
        return out

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they leave."""
        parts = residual.reshape(len(residual), SUBSPACES, -1)
        codes = np.empty((len(residual), SUBSPACES), np.uint8)
        for m, book in enumerate(self.books):
            codes[:, m] = ((book**2).sum(1) - 2 * parts[:, m] @ book.T).argmin(1)
        said = self.books[np.arange(SUBSPACES), codes].reshape(len(residual), -1)
        return codes, np.linalg.norm(residual - said, axis=1)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; a centre that loses all rows stays."""
    out = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        length = (out**2).sum(1)
        own = np.concatenate([(length - 2 * x[k : k + FIT_ROWS] @ out.T).argmin(1) for k in range(0, len(x), FIT_ROWS)])
        size = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
        out[filled] = np.add.reduceat(x[order], starts, axis=0) / size[filled, None]
    return out


def fit_rows(x: np.ndarray, lists: int) -> Model:
    """``x`` holds unit vectors of a width that SUBSPACES divides."""
    coarse = centres(x, min(lists, len(x)))
    model = Model(coarse, np.empty((0,)))
    residual = (x - coarse[model.nearest(x, 1)[:, 0]]).reshape(len(x), SUBSPACES, -1)
    model.books = np.stack([centres(residual[:, m], min(CODES, len(x))) for m in range(SUBSPACES)])
    return model


def _unit(lists: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, filled to ``width``, and which rows have one."""
    out, good = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
    for i, v in enumerate(lists):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        out[i, : len(v)] = v
        good[i] = np.isfinite(out[i]).all()
    out[~good] = 0
    with np.errstate(all="ignore"):
        scale = np.abs(out).max(axis=1, keepdims=True, initial=0)
        out = np.where(scale > 0, out / scale, 0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.where(size > 0, out / size, 0)
    return out, good & (size[:, 0] > 0)


def units(vectors: DataFrame, width: int) -> DataFrame:
    """``vec_id``, ``same`` (a digest of the vector, null if it links with nothing) and ``unit`` (doubles)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                unit, good = _unit(part.column("embedding").to_pylist(), width)
                data = [u.tobytes() if g else None for u, g in zip(unit, good, strict=True)]
                same = [xxhash.xxh3_128_hexdigest(np.array(v, np.float64).tobytes()) if g else None for v, g in zip(part.column("embedding").to_pylist(), good, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.string()), pa.array(data, pa.binary())], ["vec_id", "same", "unit"])

    return in_arrow(take(vectors, "vec_id", "embedding"), run, f"vec_id {kind}, same string, unit binary")


def indexed(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``probes`` (nearest lists, own list first), ``codes`` and ``error`` to id, weight and unit."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(part.num_rows, model.width)
                probes = model.nearest(x, PROBES)
                codes, error = model.code(x - model.centres[probes[:, 0]])
                columns = [
                    part.column("id"), part.column("weight"), part.column("unit"),
                    pa.array(list(probes.astype(np.int32)), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "weight", "unit", "probes", "codes", "error"])

    return in_arrow(rows.select("id", "weight", "unit"), run, f"id {kind}, weight long, unit binary, probes array<int>, codes binary, error double")


def _block(model: Model, ask: pd.DataFrame, have: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (asking, indexed) of the pairs of a block of one list that are similar."""
    q = np.frombuffer(b"".join(ask["unit"]), np.float64).reshape(len(ask), -1)
    v = np.frombuffer(b"".join(have["unit"]), np.float64).reshape(len(have), -1)
    codes = np.frombuffer(b"".join(have["codes"]), np.uint8).reshape(len(have), SUBSPACES)
    near = np.repeat((q @ model.centres[have["list"].iloc[0]])[:, None], len(have), axis=1)
    parts = q.reshape(len(q), SUBSPACES, -1)
    for m, book in enumerate(model.books):
        near += (parts[:, m] @ book.T)[:, codes[:, m]]
    may = near + have["error"].to_numpy()[None, :] >= SIMILAR - 1e-9
    if may.mean() > 0.05:
        close = q @ v.T >= SIMILAR
        a, b = np.nonzero(may & close)
    else:
        a, b = np.nonzero(may)
        good = np.concatenate([np.einsum("ij,ij->i", q[a[k : k + ROWS_AT_ONCE]], v[b[k : k + ROWS_AT_ONCE]]) >= SIMILAR for k in range(0, len(a), ROWS_AT_ONCE)] or [np.empty(0, bool)])
        a, b = a[good], b[good]
    other = ask["id"].to_numpy()[a] != have["id"].to_numpy()[b]
    return a[other], b[other]


def _compare(model: Model, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
    """Counts and local least ids of a block, for every vector with a link."""
    a, b = _block(model, ask, have)
    ids = np.concatenate([ask["id"].to_numpy(), have["id"].to_numpy()])
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, a, have["weight"].to_numpy()[b])
    # the indexed vector counts here only what it does not ask for itself
    own = ask["own"].to_numpy()
    asks = [set(p) for p in have["probes"]]
    alone = np.fromiter((own[i] not in asks[j] for i, j in zip(a, b, strict=True)), bool, len(a))
    np.add.at(count, len(ask) + b[alone], ask["weight"].to_numpy()[a[alone]])
    least, before = ids.copy(), None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, a, least[len(ask) + b])
        np.minimum.at(least, len(ask) + b, least[a])
    linked = np.unique(np.concatenate([a, len(ask) + b]))
    return pd.DataFrame({"id": ids[linked], "n": count[linked], "least": least[linked]})


def links(rows: DataFrame, model: Model) -> DataFrame:
    """``id``, ``n`` and ``least`` per block and vector with a link there."""
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.withColumn("list", F.get("probes", F.lit(0)))
    probing = rows.select(F.explode("probes").alias("list"), F.col("id"), "weight", "unit", F.get("probes", F.lit(0)).alias("own"))
    # at most MAX_LISTS rows of counts
    sizes = {r["list"]: r["n"] for r in own.groupBy("list").agg(F.count("*").alias("n")).collect()}
    asked = {r["list"]: r["n"] for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
    number = lambda counts, size: F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, math.ceil(n / size)))) if counts else None
    blocks, turns = number(sizes, BLOCK_INDEXED), number(asked, BLOCK_ASKING)
    if blocks is None:
        return rows.sparkSession.createDataFrame([], f"id {kind}, n long, least {kind}")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    number_of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    have = own.withColumn("block", number_of(blocks[F.col("list")])).withColumn("turn", every(turns[F.col("list")]))
    ask = probing.where(F.col("list").isin(list(sizes))).withColumn("turn", number_of(turns[F.col("list")])).withColumn("block", every(blocks[F.col("list")]))
    key = ["list", "block", "turn"]

    def run(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"id": [], "n": [], "least": []}).astype("int64")
        return _compare(model, ask, have)

    return ask.groupBy(*key).cogroup(have.groupBy(*key)).applyInPandas(run, f"id {kind}, n long, least {kind}")


def classes(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each vector."""
    staged = Staged(vectors.sparkSession, "vectors")
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(SUBSPACES, -(-longest // SUBSPACES) * SUBSPACES)
    rows, _ = staged.write(units(vectors, width))
    alike = rows.where("vec_id is not null and same is not null").groupBy("same")
    alike, _ = staged.write(alike.agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("unit").alias("unit")))
    n = alike.count()
    result = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("same")).alias("same")).join(alike.select("same", "id", "weight"), "same", "left")
    if n > 1:
        lists = max(1, min(MAX_LISTS, n // LIST_LENGTH))
        picked = sample(alike, "id", max(MIN_SAMPLE, lists * SAMPLE_PER_LIST)).select("unit").collect()
        model = fit_rows(np.frombuffer(b"".join(r["unit"] for r in picked), np.float64).reshape(len(picked), width), lists)
        index, _ = staged.write(indexed(alike, model))
        found, _ = staged.write(links(index, model))
        counts = found.groupBy("id").agg(F.sum("n").alias("others"))
        labels = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")), staged)
        result = result.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    else:
        result = result.select("*", F.lit(0).cast("long").alias("others"), F.col("id").alias("component"))
    known = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "id", "vec_id"))
    return result.select(
        "vec_id",
        (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        known.alias("component_id"),
        F.coalesce(known == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
