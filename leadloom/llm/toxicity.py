"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows that mark toxic texts, one
on ordinary windows.  A window is one to ``LONGEST`` consecutive words, overlapping;
digits and marks inside words stay, those around them go.  A window that the toxic
dictionary compresses much better than the ordinary one speaks for toxicity.  Its
margin is

    (ordinary - toxic) / (ordinary - empty)  *  min(1, (ordinary - toxic) / 8)

in compressed bytes, ``empty`` being those of the padding alone.  The score of a
text rises with the largest margin of its windows.  The threshold is set on
labelled texts that the dictionaries used for it have not seen.

The toxic dictionary holds windows that stand in many toxic and hardly any ordinary
texts: single words, and phrases of words that are ordinary each.  Windows of several words are measured where all their words occur in
such phrases; no other window can match one as a whole.

Windows are padded, as zstandard stores very short inputs uncompressed, and
widened to UTF-16, so that characters no dictionary knows cost more.

The model is fitted on every whole labelled text that is not held out, less near
copies.  Tasks count in how many texts windows and words stand, of the toxic and the
ordinary ones, in each of two halves; what the driver gets is bounded by the sizes
of the dictionaries and by the shares a window must have.  Counts are taken per
``PER_TEXTS`` texts, so that what is telling does not depend on how many there are.
For the threshold every labelled text is scored with the dictionaries of the other
half.  Every text is scored as a whole.  Null and empty texts have margin 0.
A document labelled twice is toxic if one label says so, and so is a text that
several documents have.  Without toxic labels no window is toxic and every score is low.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import Staged, in_arrow, slices, take
from leadloom.operators.keys import key_filter

#: Toxic and ordinary texts that counts are given per, where there are more.
PER_TEXTS = {1: 1000, 0: 3000}
PREDICT_FROM = 0.7

#: Words of a window, and characters of a word; longer words are cut into overlapping pieces.
LONGEST, WORD_CHARS = 4, 64
AROUND = re.compile(r"^[^\w]+|[^\w]+$")
#: Toxic texts, per ``PER_TEXTS``, in which a window must stand to be looked at.
MIN_TEXTS = 4
TOXIC_BYTES, ORDINARY_BYTES = 8192, 65536
#: More words than this never fit the ordinary dictionary: each has a letter and two blanks of two bytes.
ORDINARY_WORDS = ORDINARY_BYTES // 6
#: Windows that a task counts before it hands their counts on.
COUNTED_WINDOWS = 100_000
#: A byte may be the rounding of how far a match lies.
LEAST_GAIN = 2
PHRASE_BYTES = 4096
PAD = bytes(48)
#: A likelihood ratio that chance gives to about one window in 100,000.
MIN_SURPLUS = 20.0
STEEPNESS = 20.0
CACHED_WINDOWS = 100_000


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    phrase_words: frozenset[str]
    threshold: float

    def scorer(self) -> Scorer:
        return Scorer(self.toxic, self.ordinary, self.phrase_words)


def words_of(text: str | None) -> list[str]:
    """The words of a text without marks around them."""
    out = []
    for word in (text or "").lower().split():
        if not (word[0].isalnum() and word[-1].isalnum()):
            word = AROUND.sub("", word)
            if not word:
                continue
        if len(word) <= WORD_CHARS:
            out.append(word)
        else:
            out += [word[k : k + WORD_CHARS] for k in range(0, len(word) - WORD_CHARS // 2, WORD_CHARS // 2)]
    return out


def windows(words: list[str], n: int) -> list[str]:
    """All windows of ``n`` words."""
    return words if n == 1 else [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]


def phrases(words: list[str], within: Iterable[str]) -> set[str]:
    """The windows of two words and more that have only words of ``within``."""
    found: set[str] = set()
    run: list[str] = []
    for word in [*words, None]:
        if word in within:
            run.append(word)
        elif run:
            for n in range(2, min(len(run), LONGEST) + 1):
                found.update(windows(run, n))
            run = []
    return found


def _wide(window: str) -> bytes:
    return f" {window} ".encode("utf-16-le")


class Scorer:
    """Margins of windows under two dictionaries; lives in one process."""

    def __init__(self, toxic: bytes, ordinary: bytes, phrase_words: frozenset[str] = frozenset()):
        # binary trees: with hash chains, matches in dictionaries beyond 16 KB were not found
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=18, search_log=7, min_match=3, target_length=32,
            strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        self.silent = not toxic or not ordinary
        if not self.silent:
            half = len(ordinary) // 4 * 2
            turned = ordinary[half:] + ordinary[:half]
            self.toxic, self.ordinary, self.turned = (self._compressor(d, settings) for d in (toxic, ordinary, turned))
            self.empty = len(self.ordinary.compress(PAD))
        # windows of late, and those before them: what is frequent stays when the rest is dropped
        self.known: dict[str, float] = {}
        self.before: dict[str, float] = {}
        self.phrase_words = phrase_words

    @staticmethod
    def _compressor(content: bytes, settings) -> zstandard.ZstdCompressor:
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=primed)

    def margin(self, window: str) -> float:
        found = self.known.get(window)
        if found is not None:
            return found
        if len(self.known) >= CACHED_WINDOWS // 2:
            self.before, self.known = self.known, {}
        found = self.before.get(window)
        if found is None:
            data = PAD + _wide(window)
            ordinary = len(self.ordinary.compress(data))
            gain = ordinary - len(self.toxic.compress(data))
            if gain >= LEAST_GAIN:
                # the compressor may miss what a dictionary holds: a gain must hold against two arrangements
                ordinary = min(ordinary, len(self.turned.compress(data)))
                gain = ordinary - len(self.toxic.compress(data))
            found = gain / (ordinary - self.empty) * min(1.0, gain / 8) if gain >= LEAST_GAIN and ordinary > self.empty else 0.0
        self.known[window] = found
        return found

    def text_margin(self, text: str | None) -> float:
        return 0.0 if self.silent else self.words_margin(words_of(text))

    def words_margin(self, words: list[str]) -> float:
        if self.silent:
            return 0.0
        return max(map(self.margin, {*words, *phrases(words, self.phrase_words)}), default=0.0)


def _surplus(toxic: float, ordinary: float, share: float) -> float:
    """Log-likelihood ratio of a window that stands in more toxic texts than its share of all; 0 if in fewer."""
    n = toxic + ordinary
    if not toxic or toxic <= n * share:
        return 0.0
    gain = toxic * math.log(toxic / (n * share))
    return 2 * (gain + (ordinary * math.log(ordinary / (n * (1 - share))) if ordinary else 0.0))


@dataclass
class Tally:
    """Counts of labelled texts: how many there are of each label, and in how many windows and words stand."""

    texts: dict[int, int]
    #: Of windows of toxic texts: toxic texts, contexts in them, ordinary texts.
    windows: dict[str, tuple[int, int, int]]
    #: The words most frequent in ordinary texts, the most frequent first.
    words: list[str]

    def rate(self, label: int) -> float:
        """What a count of texts is multiplied by to be one per ``PER_TEXTS``."""
        return min(1.0, PER_TEXTS[label] / max(1, self.texts[label]))

    def share(self) -> float:
        toxic, ordinary = (self.texts[label] * self.rate(label) for label in (1, 0))
        return toxic / max(1.0, toxic + ordinary)

    def least(self) -> float:
        """Toxic texts without which no window can be telling, whatever ordinary texts say."""
        surplus = -2 * math.log(max(self.share(), 1e-9))
        return max(MIN_TEXTS, MIN_SURPLUS / max(surplus, 1e-9)) / self.rate(1)

    def telling(self) -> set[str]:
        """The windows that mark toxic texts; of ones inside each other the most telling, then the shortest.

        They are in many toxic and hardly any ordinary texts and stand in several
        contexts: windows of copied texts stand in one context however often the text
        is copied.
        """
        share, often = self.share(), self.least() * (1 - 1e-9)
        found: list[tuple[float, int, str]] = []
        for window, (k, contexts, clean) in self.windows.items():
            if k >= often and len(window) > 2:
                surplus = _surplus(min(contexts, k * self.rate(1)), clean * self.rate(0), share)
                if surplus >= MIN_SURPLUS:
                    found.append((-surplus, window.count(" ") + 1, window))
        kept: set[str] = set()
        inside: set[str] = set()  # parts of windows that are kept
        for _, n, window in sorted(found):
            parts = {p for m in range(1, n) for p in windows(window.split(" "), m)}
            if window not in inside and kept.isdisjoint(parts):
                kept.add(window)
                inside |= parts
        return kept

    def dictionaries(self) -> tuple[bytes, bytes, frozenset[str]]:
        """Toxic and ordinary dictionary, and the words of telling phrases.

        Both begin with the words of ordinary texts.  Behind them one holds the toxic windows,
        the other the words of the same phrases in another order: a word costs the same
        under both, as it lies equally far, and only what toxic texts say costs less.
        The most frequent words come last, those of each dictionary that has no room for all.
        """
        often = sorted(self.telling(), key=lambda w: (-self.windows[w][0], w))
        single = {w: _wide(w) for w in often if " " not in w}
        ordinary = _fitting([_wide(w) for w in self.words if w not in single], ORDINARY_BYTES)
        if not often:
            return b"", ordinary, frozenset()
        alone = _fitting(list(single.values()), TOXIC_BYTES)
        said = [w for w in often if " " in w]
        room = np.cumsum([len(_wide(w)) for w in said])
        said = said[: int(np.searchsorted(room, PHRASE_BYTES, "right"))]
        toxic = alone + b"".join(map(_wide, said))
        turned = bytes(len(alone)) + b"".join(_wide(" ".join(reversed(w.split(" ")))) for w in said)
        return ordinary + toxic, ordinary + turned, frozenset(x for w in said for x in w.split(" "))


def _fitting(parts: list[bytes], size: int) -> bytes:
    """As many of the first parts as fit, the first one last."""
    room = np.cumsum([len(p) for p in parts])
    return b"".join(reversed(parts[: int(np.searchsorted(room, size, "right"))]))


def _tally(toxic: list[list[str]], ordinary: list[list[str]]) -> Tally:
    """The counts of texts in memory."""
    every = lambda words: {w for n in range(1, LONGEST + 1) for w in windows(words, n)}
    counts = Counter(w for words in toxic for w in every(words))
    contexts, clean = defaultdict(set), Counter(w for words in ordinary for w in set(words))
    for words in toxic:
        for n in range(1, LONGEST + 1):
            for before, window in zip(["", *words], windows(words, n), strict=False):
                contexts[window].add(before)
    often = sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:ORDINARY_WORDS]
    clean.update(w for words in ordinary for w in every(words) & counts.keys() if " " in w)
    return Tally({1: len(toxic), 0: len(ordinary)}, {w: (k, len(contexts[w]), clean[w]) for w, k in counts.items()}, [w for w, _ in often])


def telling_windows(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    return _tally(toxic, ordinary).telling()


def dictionaries(texts: list[tuple[str, int]]) -> tuple[bytes, bytes, frozenset[str]]:
    """The dictionaries of labelled texts in memory."""
    cut = [(words_of(t), label) for t, label in dict(texts).items()]
    return _tally(*([words for words, label in cut if label == side] for side in (1, 0))).dictionaries()


def threshold(margins: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> float:
    """Where the share of hits less the share of false alarms is greatest, in the middle of its gap.

    Each margin stands for as many texts as ``times`` says.
    """
    if not labels.any() or labels.all():
        return 0.7
    times = np.ones(len(margins), np.int64) if times is None else times
    points = np.unique(margins)
    middles = (points[:-1] + points[1:]) / 2
    if not middles.size:
        return 0.7

    def below(side: int) -> np.ndarray:
        """The share of the texts of one label that have less than each middle."""
        order = np.argsort(margins[labels == side])
        upto = np.concatenate([[0], np.cumsum(times[labels == side][order])])
        return upto[np.searchsorted(margins[labels == side][order], middles)] / upto[-1]

    gain = below(0) - below(1)
    best = np.flatnonzero(gain == gain.max())
    widest = best[np.argmax((points[1:] - points[:-1])[best])]
    return float(middles[widest])


def _least_triples(words: list[str]) -> list[int]:
    """The four least hashes of the word triples."""
    triples = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return sorted({zlib.crc32(t.encode()) for t in triples})[:4]


def copy_keys(words: list[str]) -> list[tuple[int, ...]]:
    """Keys of which near copies share one: three of the four least hashed word triples, or all if there are fewer."""
    least = _least_triples(words)
    return list(combinations(least, min(3, len(least))))


def _apart(texts: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies of earlier texts."""
    seen, kept = set(), []
    for text, label in texts:
        keys = copy_keys(words_of(text))
        if seen.isdisjoint(keys):
            kept.append((text, label))
        seen.update(keys)
    return kept


def fit_texts(texts: list[tuple[str, int]]) -> Model:
    """``fit`` on labelled texts in memory; two halves set each other's margins for the threshold."""
    texts = _apart(list(dict(texts).items()))
    margins, labels = [], []
    for half in (0, 1):
        scorer = Scorer(*dictionaries(texts[half::2]))
        margins += [scorer.text_margin(t) for t, _ in texts[1 - half :: 2]]
        labels += [label for _, label in texts[1 - half :: 2]]
    return Model(*dictionaries(texts), threshold(np.array(margins), np.array(labels, int)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame, staged: Staged) -> dict[int, DataFrame]:
    """``half`` and ``words`` of the labelled whole texts that are not held out, without near copies, by label.

    Of near copies the one with the least digest stays, as the first of all its keys.
    """
    marks = take(labels, "doc_id", "toxic").dropna().where(~held_out()).where("toxic in (0, 1)")
    marks, _ = staged.write(marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    # texts are not moved to their labels: most have none, and are left out where they are scanned
    wanted = key_filter(marks.select(F.col("doc_id").cast("string")), ["doc_id"])
    texts = take(docs, "doc_id", "text").where(~held_out() & F.col("text").isNotNull()).where(wanted(F.col("doc_id").cast("string")))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, words string, keys array<string>"

    def run(batches):
        for part in slices(batches, "text"):
            words = [words_of(t) for t in part.column("text").to_pylist()]
            keys = [[" ".join(map(str, k)) for k in copy_keys(w)] for w in words]
            columns = [part.column("doc_id"), part.column("digest"), pa.array([" ".join(w) for w in words]), pa.array(keys, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "words", "keys"])

    cut = in_arrow(texts.select("doc_id", F.md5("text").alias("digest"), "text"), run, schema)
    rows, path = staged.write(cut.withColumn("row", F.monotonically_increasing_id()))
    named, _ = staged.write(rows.drop("words").join(marks, "doc_id").drop("doc_id"))
    firsts = named.select("digest", F.explode("keys").alias("key")).groupBy("key").agg(F.min("digest").alias("digest"))
    firsts = firsts.groupBy("digest").agg(F.count("*").alias("first_of"))
    each = named.groupBy("digest").agg(F.max("toxic").alias("label"), F.min("row").alias("row"), F.max(F.size("keys")).alias("n_keys"))
    kept = each.join(firsts, "digest").where("first_of = n_keys").select("row", "label", (F.crc32("digest") % 2).cast("int").alias("half"))
    kept = rows.select("row", "words").join(kept, "row").select("label", "half", "words")
    both, first = staged.write(kept)
    staged.drop(path)
    out = {label: staged.write(both.where(F.col("label") == label).select("half", "words"))[0] for label in (1, 0)}
    staged.drop(first)
    return out


def _counted(texts: DataFrame, parts: Callable[[list[str]], Iterable[str]]) -> DataFrame:
    """``window``, and in how many texts of the one half (``n0``) and the other (``n1``) it stands; ``parts`` of a text are distinct."""

    def run(batches):
        times = (Counter(), Counter())

        def flush():
            names = list(times[0].keys() | times[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([t[w] for w in names], pa.int64()) for t in times)]
            for t in times:
                t.clear()
            return pa.RecordBatch.from_arrays(columns, ["window", "n0", "n1"])

        for part in slices(batches, "words"):
            for half, words in zip(part.column("half").to_pylist(), part.column("words").to_pylist(), strict=True):
                times[half].update(parts(words.split(" ") if words else []))
                if len(times[0]) + len(times[1]) >= COUNTED_WINDOWS:
                    yield flush()
        yield flush()

    counts = in_arrow(texts, run, "window string, n0 long, n1 long")
    return counts.groupBy("window").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _contexts(texts: DataFrame, often: frozenset[str]) -> DataFrame:
    """``window`` and before how many words it stands in the halves (``c0``, ``c1``) and in both together (``c``)."""

    def run(batches):
        for part in slices(batches, "words"):
            found = [set(), set()]
            for half, words in zip(part.column("half").to_pylist(), part.column("words").to_pylist(), strict=True):
                words = words.split(" ") if words else []
                for n in range(1, LONGEST + 1):
                    found[half].update(x for x in zip(windows(words, n), ["", *words], strict=False) if x[0] in often)
            every = list(found[0] | found[1])
            columns = [pa.array([w for w, _ in every], pa.string()), pa.array([b for _, b in every], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([int(x in f) for x in every], pa.int32()) for f in found)], ["window", "before", "in0", "in1"])

    pairs = in_arrow(texts, run, "window string, before string, in0 int, in1 int")
    pairs = pairs.groupBy("window", "before").agg(F.max("in0").alias("in0"), F.max("in1").alias("in1"))
    return pairs.groupBy("window").agg(F.sum("in0").alias("c0"), F.sum("in1").alias("c1"), F.count("*").alias("c"))


#: Of the columns of counts, those of the one half, of the other, and of all.
_SETS = (("n0", "c0", "o0"), ("n1", "c1", "o1"), ("n0 + n1", "c", "o0 + o1"))


def _tallies(texts: dict[int, DataFrame], staged: Staged) -> list[Tally]:
    """The counts of the one half, of the other, and of all."""
    sizes = {label: dict.fromkeys((0, 1), 0) | {r.half: r["count"] for r in t.groupBy("half").count().collect()} for label, t in texts.items()}
    tallies = [Tally({label: n.get(half, sum(n.values())) for label, n in sizes.items()}, {}, []) for half in (0, 1, None)]
    # a window that no set of texts can find telling is not looked at, and none has a word that is rarer than itself
    can = " or ".join(f"{n} >= {t.least() * (1 - 1e-9)!r}" for t, (n, _, _) in zip(tallies, _SETS, strict=True))
    words, _ = staged.write(_counted(texts[1], set).where(can))
    known = frozenset(r.window for r in words.select("window").collect())
    longer, _ = staged.write(_counted(texts[1], lambda cut: phrases(cut, known)).where(can))
    phrased = frozenset(r.window for r in longer.select("window").collect())
    within = frozenset(x for w in phrased for x in w.split(" "))
    ordinary, _ = staged.write(_counted(texts[0], lambda cut: {*cut, *(phrases(cut, within) & phrased)}))
    clean = ordinary.select("window", F.col("n0").alias("o0"), F.col("n1").alias("o1"))
    toxic = words.unionByName(longer).join(_contexts(texts[1], known | phrased), "window").join(clean, "window", "left").na.fill(0)
    rows = toxic.selectExpr("window", *(f"struct({n} as k, {c} as c, {o} as o) as s{i}" for i, (n, c, o) in enumerate(_SETS))).collect()
    single = clean.where(~F.contains("window", F.lit(" ")))
    for i, (tally, (_, _, o)) in enumerate(zip(tallies, _SETS, strict=True)):
        tally.windows = {r.window: tuple(r[f"s{i}"]) for r in rows}
        often = single.where(f"{o} > 0").orderBy(F.expr(o).desc(), "window").limit(ORDINARY_WORDS)
        tally.words = [r.window for r in often.select("window").collect()]
    return tallies


def _unseen_margins(texts: DataFrame, halves: list[tuple]) -> list:
    """``margin`` and ``n``: how many texts have it under the dictionaries of the half they are not in.

    Margins are ratios of a few hundred bytes, so there are not many.
    """

    def run(batches):
        scorers, times = [Scorer(*d) for d in halves], Counter()
        for part in slices(batches, "words"):
            for half, words in zip(part.column("half").to_pylist(), part.column("words").to_pylist(), strict=True):
                times[scorers[1 - half].words_margin(words.split(" ") if words else [])] += 1
        columns = [pa.array(times.keys(), pa.float64()), pa.array(times.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["margin", "n"])

    return in_arrow(texts, run, "margin double, n long").groupBy("margin").agg(F.sum("n").alias("n")).collect()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all whole labelled documents that are not held out."""
    staged = Staged(docs.sparkSession, "toxicity")
    texts = _labelled(docs, labels, staged)
    first, second, every = _tallies(texts, staged)
    halves = [first.dictionaries(), second.dictionaries()]
    seen = [(label, r.margin, r.n) for label, t in texts.items() for r in _unseen_margins(t, halves)]
    marks, margins, times = (np.array([x[k] for x in seen], kind) for k, kind in enumerate((int, float, np.int64)))
    model = Model(*every.dictionaries(), threshold(margins, marks, times))
    staged.drop(staged.base)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``margin`` and ``score`` of every text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, margin double"

    def run(batches):
        scorer = model.scorer()
        for part in slices(batches, "text"):
            margins = [scorer.text_margin(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(margins, pa.float64())], ["doc_id", "margin"])

    lift = math.log(PREDICT_FROM / (1 - PREDICT_FROM))
    logit = STEEPNESS * (F.col("margin") - model.threshold) + lift
    return in_arrow(take(docs, "doc_id", "text"), run, schema).withColumn("score", 1 / (1 + F.exp(-logit)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)

    def run(batches):
        scorer = model.scorer()
        for part in slices(batches, "text"):
            calm = [scorer.text_margin(t) < model.threshold for t in part.column("text").to_pylist()]
            yield part.filter(pa.array(calm))

    return in_arrow(docs, run, docs.schema)
