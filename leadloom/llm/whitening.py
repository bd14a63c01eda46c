"""Whitening of embeddings by eigenvectors refined in mixed precision.

1. Vectors become whole numbers, ``floor(SCALE * c)``.  The distinct ones are the
   fit list, written once.  Their number ``n`` and sums ``S`` are exact, so what is
   centred is the exact ``n * x - S``.
2. The covariance (divisor n, centred before it is multiplied) is one small matrix
   a task, added by Spark.  Only such matrices reach the driver: their size is the
   square of the width, whatever the number of rows.
3. The driver solves for eigenvectors in float32 and refines them by Ogita and
   Aishima's iteration: with R = I - X'X and S = X'AX, the correction is
   X (I + E), E[i, j] = (S[i, j] + l[j] R[i, j]) / (l[j] - l[i]), or R[i, j] / 2
   where two eigenvalues are too near to tell apart.  Products are in extended
   precision; each round doubles the number of right digits.  Eigenvalues too near
   to each other form a cluster, whose vectors are turned by an eigenproblem of the
   cluster's own size, shifted by its mean so that its small gaps keep their digits.
4. Rows are projected where they lie, without a shuffle.

Vectors that are null, or hold null or non-finite entries, are dropped.  Shorter
vectors are filled up with zeros to the longest; empty ones are all zeros.  Numbers
beyond a long stay at its bounds.  Rows of one id, and rows without one, are rows
each; equal vectors count once in the fit.  A component without variance has
``whitened`` 0 (so has one of an only vector), ``explained`` 0 and no part in the
identity check.  An empty table, or one whose vectors are all dropped, gives an
empty table.  Further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.moments import covariance, doubles, matrices
from leadloom.llm.shared import Staged, in_arrow, take

SCALE = 256
COMPONENTS = 4
ROUNDS, SETTLED = 20, 5
#: Numbers below this bound are added and multiplied as 64-bit whole numbers.
SAFE = 2**62
#: Eigenvalues nearer than this, by the greatest, are told apart by their cluster's own problem only: the matrix itself is rounded so.
SAME = 1e-15
#: Eigenvalues below this share of the greatest are rounding, not variance.
NO_VARIANCE = 1e-13
_WHOLE = pa.decimal128(38, 0)


@dataclass
class Fit:
    """What whitening needs: exact size and sums of the fit list, eigenvalues (falling) and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)


def _clusters(values: np.ndarray, near: float) -> list[slice]:
    """Runs of two or more falling values whose neighbours differ by at most ``near``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > near) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]


def _upright(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made orthonormal to extended precision."""
    for _ in range(3):
        x = x + x @ (np.eye(x.shape[1]) - x.T @ x) / 2
    return x


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    d = len(matrix)
    greatest = np.abs(matrix).max(initial=0.0)
    if not d or not greatest > 0:
        return np.zeros(d), np.eye(d)
    scale = 2.0 ** np.ceil(np.log2(greatest))
    a = (matrix / scale).astype(np.longdouble)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    one, before = np.eye(d, dtype=np.longdouble), np.inf
    for turn_number in range(ROUNDS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # unlike rounding on both sides would be divided by small gaps
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        wrong = s - np.diag(values)
        near = 2 * (np.sqrt((wrong**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
        near = max(near, SAME * np.abs(values).max())
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        change = float(np.abs(e).max())
        x = x + x @ e
        for part in _clusters(values, float(near)):
            own = x[:, part]
            middle = values[part].mean()
            small = own.T @ (a @ own - middle * own)
            size = max(float(np.abs(small).max()), np.finfo(np.float64).tiny)
            turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
            x[:, part] = _upright(own @ _upright(turn))
        # the first rounds may only have turned clusters; what a small gap leaves of rounding does not fall further
        if change < 1e-17 or (turn_number >= SETTLED and change >= before / 2):
            break
        before = change
    x = _upright(x)
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return (values[order] * scale).astype(np.float64), (x * signs).astype(np.float64)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up to ``width``, and which rows are usable."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
    inner = column.flatten()
    if len(sizes) and (sizes == width).all() and not inner.null_count:
        out = inner.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        for i, v in enumerate(column.to_pylist()):
            if v is None or any(c is None for c in v):
                out[i] = np.nan
                if not width:
                    sizes[i] = -1
            else:
                # wider ones hold entries that are not finite: the width is that of the longest usable vector
                out[i, : len(v)] = v[:width] if len(v) <= width else np.nan
    return out, np.isfinite(out).all(axis=1) & (sizes >= 0)


def whole(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id`` and ``x`` (longs) of the usable vectors, and their width."""
    rows = take(vectors, "vec_id", "embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    width = rows.where(F.coalesce(finite, F.lit(False))).agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            c, good = _matrix(batch.column("embedding"), width)
            with np.errstate(all="ignore"):
                far = np.floor(SCALE * c[good])
                x = np.clip(far, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            x[far >= 2.0**63] = 2**63 - 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), lists], ["vec_id", "x"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return in_arrow(rows, run, f"vec_id {kind}, x array<bigint>"), width


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Exact size and sums of the fit list."""

    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = doubles(batch.column("x"), width) if width else np.zeros((batch.num_rows, 0), np.int64)
            n += len(x)
            if x.size and int(np.abs(x.astype(np.float64)).max()) * len(x) >= SAFE:
                x = x.astype(object)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        numbers = pa.array([Decimal(v) for v in [n, *total]], _WHOLE)
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), numbers], ["i", "total"])

    found = in_arrow(fit, run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    by = {r.i: int(r.total) for r in found}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(width)]


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """The exact ``n * x - S``: 64-bit numbers where they fit, else Python's."""
    if x.size and n * int(np.abs(x.astype(np.float64)).max()) + max(map(abs, sums)) < SAFE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(apart: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if apart.dtype != object and apart.size and int(np.abs(apart).max()) ** 2 * apart.shape[1] >= SAFE:
        apart = apart.astype(object)
    return [int(v) for v in (apart * apart).sum(axis=1)]


def fit_whole(fit: DataFrame, width: int) -> Fit | None:
    """Fit on a list of distinct ``x``; None if it is empty."""
    n, sums = _sums(fit, width)
    if not n:
        return None
    if not width:
        return Fit(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)

    def products(batch):
        c = _apart(doubles(batch.column("x"), width), n, sums).astype(np.float64) / n
        return [(0, c.T @ c)]

    v = matrices(fit, products, width)[0] / n
    return Fit(n, sums, *eigen(v), float(np.trace(v)))


def _project(x: np.ndarray, model: Fit, components: int) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S``, and the whitened values of each row."""
    apart = _apart(x, model.n, model.sums)
    e = model.values[:components]
    seen = e > NO_VARIANCE * max(model.values.max(initial=0.0), 0.0)
    scale = np.where(seen, 1 / np.sqrt(np.where(seen, e, 1)), 0)
    return apart, (apart.astype(np.float64) / model.n) @ (model.vectors[:, :components] * scale)


def whiten(rows: DataFrame, model: Fit, components: int) -> DataFrame:
    """``rows`` (any columns and ``x``) with ``deviation`` (null beyond 38 digits) and ``whitened`` (array)."""
    width, k = model.width, min(components, model.width)
    keep = [c for c in rows.columns if c != "x"]

    def run(batches):
        for batch in batches:
            x = doubles(batch.column("x"), width) if width else np.zeros((batch.num_rows, 0), np.int64)
            apart, white = _project(x, model, k)
            squares = [Decimal(v) if v < 10**38 else None for v in _squares(apart)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(k)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(squares, _WHOLE), lists], [*keep, "deviation", "whitened"])

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    return in_arrow(rows, run, ", ".join([*fields, "deviation decimal(38,0)", "whitened array<double>"]))


def identity_error(fit: DataFrame, model: Fit, components: int) -> float:
    """The greatest entry of the whitened fit list's covariance less the identity, over components with variance."""
    k = min(components, model.width)
    seen = model.values[:k] > NO_VARIANCE * model.values.max(initial=0.0)
    if not seen.any():
        return 0.0
    white = covariance(whiten(fit, model, k), "whitened", k, model.n)[np.ix_(seen, seen)]
    return float(np.abs(white - np.eye(len(white))).max())


def digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component; ``deviation`` is null beyond a long."""
    staged = Staged(vectors.sparkSession, "whitening")
    rows, width = whole(vectors)
    rows, _ = staged.write(rows)
    fit, _ = staged.write(rows.select("x").distinct())
    model = fit_whole(fit, width)
    if model is None:
        model = Fit(1, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    explained = np.maximum(model.values, 0) / model.trace if model.trace > 0 else model.values * 0
    shares = F.array(*(F.lit(float(v)) for v in explained[:components])).cast("array<double>")
    made = whiten(rows, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return made.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(identity_error(fit, model, components)).alias("identity_error"),
    )
