"""Quality by regularised quadratic discriminants of document statistics.

1. A document's statistics are counts of its characters, words and lines, as
   smoothed log odds, so that they are finite for any text and spread alike for
   short and long ones.  They are written once; texts are read once.
2. Sizes, sums and products of the statistics by fold and class are one small
   matrix a task, added by Spark, from all labelled documents that are not held
   out.  The driver only gets these matrices.
3. A class covariance is shrunk towards the one of both classes together
   (``POOLED``) and then towards a multiple of the identity (``ROUND``).  The two
   shares are chosen by cross validation, folds dealt by a hash of the text so that
   exact copies stay together.
4. A score is the difference of the two Gaussian log densities: Mahalanobis
   lengths by the inverse Cholesky factors, which are computed once and kept in the
   model.  Such differences are too sure of themselves; a logistic curve over their
   inverse hyperbolic sine is fitted on the differences of unseen folds, which
   travel as histograms of ``BINS`` bins.

Null texts are empty; empty texts have statistics like others.  Rows that share an
id are scored each.  Documents without an id are never labelled nor held out.  A
document labelled more than once is good if all its labels say so; null labels are
left out.  If no label, or only one class, is known, every score is the smoothed
share of good labels.  An empty table gives an empty table.  Further columns are
left out.  Equal texts get equal scores, and ties at 0.5 count as good.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.moments import doubles, matrices
from leadloom.llm.shared import Staged, in_arrow, slices, take

FOLDS = 5
POOLED = (0.0, 0.1, 0.3, 0.6)
ROUND = (0.001, 0.01, 0.1)
PREDICT_FROM = 0.5
#: Differences of log densities are counted in bins of their inverse hyperbolic sine.
BINS, REACH = 2400, 30.0

SPACE = " \t\n\x0b\x0c\r"
STOPS = ".,;:!?'\"()-"
NAMES = (
    "words", "word_length", "capitals", "digits", "stops", "symbols", "space", "distinct", "commonest", "stuttered",
    "again_lines", "line_words", "spread", "far_letters", "exclamations",
)
WIDTH = len(NAMES)


@cache
def _kinds() -> np.ndarray:
    """Of each character below 65,536: 0 space, 1 capital, 2 other letter, 3 digit, 4 stop, 5 symbol; those beyond count as symbols."""
    kinds = np.full(65537, 5, np.uint8)
    for code in range(65536):
        c = chr(code)
        if c in SPACE:
            kinds[code] = 0
        elif c.isalpha():
            kinds[code] = 1 if c.isupper() else 2
        elif c.isdigit():
            kinds[code] = 3
        elif c in STOPS:
            kinds[code] = 4
    return kinds


def _odds(some: float, others: float) -> float:
    return math.log((some + 0.5) / (others + 0.5))


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``NAMES``."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space, capital, letter, digit, stop, symbol = np.bincount(_kinds()[np.minimum(codes, 65536)], minlength=6).tolist()
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    n, filled = len(codes), len(codes) - space
    counts = Counter(words)
    chances = np.bincount(np.minimum(codes, 1023))
    chances = chances[chances > 0] / max(1, n)
    return [
        math.log1p(len(words)),
        _odds(filled, len(words)),
        _odds(capital, letter),
        _odds(digit, filled - digit),
        _odds(stop, filled - stop),
        _odds(symbol, filled - symbol),
        _odds(space, filled),
        _odds(len(counts), len(words) - len(counts)),
        _odds(max(counts.values(), default=0), len(words) - max(counts.values(), default=0)),
        _odds(sum(map(str.__eq__, words[1:], words)), len(words)),
        _odds(len(lines) - len(set(lines)), len(set(lines))),
        _odds(len(words), len(lines)),
        float(-(chances * np.log(chances)).sum()),
        _odds(int((codes > 127).sum()), n),
        _odds(text.count("!"), n),
    ]


@dataclass
class Gaussian:
    """A class: its mean, the inverse Cholesky factor of its covariance and the constant of its log density."""

    mean: np.ndarray
    factor: np.ndarray
    constant: float

    def log_density(self, z: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * (((z - self.mean) @ self.factor.T) ** 2).sum(axis=1)


@dataclass
class Model:
    """Scaling of the statistics, the classes (0, 1) and the curve of their difference; ``share`` stands in without classes."""

    share: float
    centre: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    spread: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    classes: tuple[Gaussian, Gaussian] | None = None
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.centre) / self.spread
        return np.arcsinh(self.classes[1].log_density(z) - self.classes[0].log_density(z))

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(stats), self.share)
        return _logistic(self.slope * self.difference(stats) + self.offset)


def _logistic(at: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(at, -700, 700)))


@dataclass
class Moments:
    """Size, sums and products of scaled statistics."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    @staticmethod
    def of(z: np.ndarray) -> np.ndarray:
        """As one matrix, with a last column of ones: sizes, sums and products together."""
        wide = np.hstack([z, np.ones((len(z), 1))])
        return wide.T @ wide

    @classmethod
    def read(cls, matrix: np.ndarray) -> Moments:
        return cls(float(matrix[-1, -1]), matrix[-1, :-1], matrix[:-1, :-1])

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n - np.outer(self.mean, self.mean)


def gaussians(bad: Moments, good: Moments, pooled: float, rounded: float) -> tuple[Gaussian, Gaussian]:
    """The two classes with shrunk covariances, their sizes as prior."""
    n = bad.n + good.n
    both = (bad.n * bad.covariance + good.n * good.covariance) / n
    out = []
    for one in (bad, good):
        shrunk = (1 - pooled) * one.covariance + pooled * both
        shrunk = (1 - rounded) * shrunk + rounded * (np.trace(shrunk) / len(shrunk) + 1e-6) * np.eye(len(shrunk))
        lower = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        constant = math.log(one.n / n) - float(np.log(np.diag(lower)).sum())
        out.append(Gaussian(one.mean, np.linalg.inv(lower), constant))
    return out[0], out[1]


def curve(counts: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean loss of the logistic curve fitted to a histogram (2, BINS) of differences by class."""
    at = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    n = counts.sum(axis=1)
    # targets pulled in by one count a class, so that classes apart still have a finite curve
    want = np.array([1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)])
    slope, offset = 1.0, 0.0
    all_ = counts.sum(axis=0)
    hits = counts[0] * want[0] + counts[1] * want[1]

    def loss(s: float, o: float) -> float:
        line = s * at + o
        return float((all_ * np.logaddexp(0, line) - hits * line).sum() / n.sum())

    now = loss(slope, offset)
    for _ in range(100):
        p = _logistic(slope * at + offset)
        g = np.array([((all_ * p - hits) * at).sum(), (all_ * p - hits).sum()])
        w = all_ * p * (1 - p)
        h = np.array([[(w * at * at).sum(), (w * at).sum()], [(w * at).sum(), w.sum()]]) + 1e-9 * np.eye(2) * (1 + n.sum())
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and (slope - size * step[0] <= 0 or loss(slope - size * step[0], offset - size * step[1]) > now):
            size /= 2
        if size <= 1e-6:
            break
        slope, offset = slope - size * step[0], offset - size * step[1]
        after = loss(slope, offset)
        if now - after < 1e-12:
            break
        now = after
    return float(slope), float(offset), loss(slope, offset)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fold`` (by the text) and ``stats`` of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            flat = np.array([statistics(t) for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(WIDTH)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), lists], ["doc_id", "fold", "stats"])

    fold = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) % FOLDS
    return in_arrow(take(docs, "doc_id", "text").withColumn("fold", fold.cast("int")), run, f"doc_id {kind}, fold int, stats array<double>")


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``fold``, ``quality`` and ``stats`` of the labelled documents that are not held out."""
    marks = take(labels, "doc_id", "quality").dropna().where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    return stats.join(marks, "doc_id").select("fold", "quality", "stats")


def _by_key(batch: pa.RecordBatch):
    """The statistics of each fold and class of a batch, under fold * 2 + class."""
    keys = batch.column("fold").to_numpy() * 2 + batch.column("quality").to_numpy()
    stats = doubles(batch.column("stats"), WIDTH)
    return [(int(k), stats[keys == k]) for k in np.unique(keys)]


def fit(rows: DataFrame) -> Model:
    """Fit on ``fold``, ``quality`` and ``stats`` (read three times, so written before)."""
    raw = {k: Moments.read(m) for k, m in matrices(rows, lambda b: [(k, Moments.of(s)) for k, s in _by_key(b)], WIDTH + 1).items()}
    n = [sum(m.n for k, m in raw.items() if k % 2 == label) for label in (0, 1)]
    model = Model((n[1] + 1) / (n[0] + n[1] + 2))
    if not all(n):
        return model
    whole = sum(raw.values(), Moments(0.0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))))
    model.centre = whole.mean
    model.spread = np.sqrt(np.maximum(np.diag(whole.covariance), 1e-12))
    centre, spread = model.centre, model.spread

    def scaled(batch):
        return [(k, Moments.of((s - centre) / spread)) for k, s in _by_key(batch)]

    parts = {k: Moments.read(m) for k, m in matrices(rows, scaled, WIDTH + 1).items()}

    def classes(without: int | None, pooled: float, rounded: float) -> tuple[Gaussian, Gaussian] | None:
        sides = [[m for k, m in parts.items() if k % 2 == label and k // 2 != without] for label in (0, 1)]
        if not all(sides):
            return None
        zero = Moments(0.0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH)))
        return gaussians(sum(sides[0], zero), sum(sides[1], zero), pooled, rounded)

    settings = [(p, r) for p in POOLED for r in ROUND]
    trial = {(fold, s): classes(fold, *setting) for fold in range(FOLDS) for s, setting in enumerate(settings)}
    counts = _differences(rows, model, trial, len(settings))
    fitted = [(curve(c), s) for s, c in sorted(counts.items()) if c.sum(axis=1).all()]
    (slope, offset, _), best = min(fitted, key=lambda f: (f[0][2], f[1])) if fitted else ((1.0, 0.0, 0.0), 0)
    model.classes = classes(None, *settings[best])
    model.slope, model.offset = slope, offset
    return model


def _differences(rows: DataFrame, model: Model, trial: dict, settings: int) -> dict[int, np.ndarray]:
    """Histograms, by setting, of the differences that models give to the fold they have not seen."""

    def run(batches):
        counts = np.zeros((settings, 2, BINS), np.int64)
        for batch in batches:
            for key, stats in _by_key(batch):
                for s in range(settings):
                    pair = trial[key // 2, s]
                    if pair is None:
                        continue
                    at = Model(model.share, model.centre, model.spread, pair).difference(stats)
                    bins = np.clip(((at + REACH) / (2 * REACH) * BINS).astype(int), 0, BINS - 1)
                    counts[s, key % 2] += np.bincount(bins, minlength=BINS)
        s, label, at = np.nonzero(counts)
        columns = [pa.array(c.astype(np.int32)) for c in (s, label, at)] + [pa.array(counts[s, label, at])]
        yield pa.RecordBatch.from_arrays(columns, ["setting", "quality", "at", "n"])

    found = in_arrow(rows, run, "setting int, quality int, at int, n long").groupBy("setting", "quality", "at").agg(F.sum("n").alias("n"))
    out = {}
    for s, some in groupby(found.orderBy("setting").collect(), key=lambda r: r.setting):
        out[s] = np.zeros((2, BINS))
        for r in some:
            out[s][r["quality"], r["at"]] = r["n"]
    return out


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of measured documents."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(doubles(batch.column("stats"), WIDTH)))], ["doc_id", "score"])

    return in_arrow(stats.select("doc_id", "stats"), run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    staged = Staged(docs.sparkSession, "quality")
    stats, _ = staged.write(measured(docs))
    known, _ = staged.write(labelled(stats, labels))
    return score(stats, fit(known)).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )
