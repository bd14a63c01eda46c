"""Secret scans: fixed patterns, and strings that are new to a primed compressor.

Three patterns give the base spans.  Beyond them, every string with a sensitive
word within ``CONTEXT`` characters before its start or behind its end is measured,
and so are the strings that follow such a one with next to nothing between (the
lines of a key).  A string that base spans cover as a whole is not measured; one
they cover in part is.  Its marginal bytes are what it adds to the compressed
size of the text around it, under a zstandard dictionary of the corpus's own
identifiers and words.  A string that hardly compresses there is reported as
``novel``.  What counts as hardly is set on the ordinary strings, long lower-case
ones that are not measured as candidates, of all texts.

The dictionary holds the words that stand in most texts, counted over all whole
texts; ordinary strings are measured in all whole texts too.  Null texts have no
spans.  Repeated rows are scanned one by one.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import in_arrow, slices, take

# The base patterns, in the order of their kinds, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so this is every run of 16 and more
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Words that make what is near them sensitive, the strings that are measured, and what may part the lines of one.
SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase|code)|secret|token|api_?key|access_?key|private_?key|credential|bearer|authorization|signature)", re.I | re.A)
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[a-z_]{16,}")
BETWEEN = re.compile(r"""[\s"'\\,;]{0,16}""")
CONTEXT, AROUND = 256, 256
DICTIONARY_BYTES = 16384
#: Characters of a word of the dictionary, and texts it stands in at least.
DICTIONARY_WORD, DICTIONARY_TEXTS = (4, 128), 2
#: Words that a task counts before it hands their counts on.
COUNTED_WORDS = 100_000
#: Words whose counts go to the driver, words of the texts drawn from them, and of one of these.
COUNTS_KEPT, DRAWN_WORDS, SAMPLE_WORDS = 20_000, 400_000, 500
LEAST_NOVELTY, ORDINARY_QUANTILE = 0.6, 0.999
#: Steps of novelty a unit in the histogram of ordinary strings.
STEPS = 1000
IDENTIFIERS = (
    "self this null none true false return const static public private import export function class value "
    "config settings client server request response header session user name path file data index count string "
    "length object array number default options password secret token api_key access_key private_key credential"
)


@dataclass
class Model:
    dictionary: bytes
    novelty: float


class Gauge:
    """Marginal compressed bytes per character; lives in one process."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary or b" " * 8)
        primed.precompute_compress(level=19)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)

    def novelty(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        size = lambda s: len(self.compressor.compress(s.encode()))
        return (size(before + text[start:end] + after) - size(before + after)) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the strings that are near a sensitive word or go on from one that is."""
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    found, k, last = [], 0, None
    for m in STRING.finditer(text) if words else ():
        start, end = m.span()
        while k < len(words) and words[k][1] + CONTEXT < start:
            k += 1  # words and strings both come in order
        near = k < len(words) and words[k][0] <= end + CONTEXT
        if near or (last is not None and start - last <= 16 and BETWEEN.fullmatch(text, last, start)):
            found.append((start, end))
            last = end
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], gauge: Gauge, least: float) -> list[tuple[int, int, int]]:
    covered, k, found = _joined(base), 0, []
    for start, end in candidates(text):
        while k < len(covered) and covered[k][1] < end:
            k += 1
        if k < len(covered) and covered[k][0] <= start:
            continue
        if gauge.novelty(text, start, end) >= least:
            found.append((start, 3, end))
    return found


def _joined(base: list[tuple[int, int, int]]) -> list[list[int]]:
    """What the spans, ordered by start, cover together."""
    out: list[list[int]] = []
    for start, _, end in base:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scan_text(text: str | None, gauge: Gauge, least: float) -> list[tuple[int, int, int]]:
    base = base_spans(text or "")
    return sorted(base + novel_spans(text or "", base, gauge, least))


def ordinary(text: str) -> list[tuple[int, int]]:
    """(start, end) of the long lower-case strings that are no part of a candidate."""
    near, k, found = candidates(text), 0, []
    for m in ORDINARY.finditer(text):
        while k < len(near) and near[k][1] <= m.start():
            k += 1
        if k == len(near) or near[k][0] >= m.end():
            found.append(m.span())
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and in how many whole texts it stands, ``n``."""
    least, most = DICTIONARY_WORD

    def run(batches):
        times = Counter()

        def flush():
            columns = [pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64())]
            times.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for part in slices(batches, "text"):
            for t in part.column("text").to_pylist():
                times.update(w for w in set(t.split()) if least <= len(w) <= most)
                if len(times) >= COUNTED_WORDS:
                    yield flush()
        yield flush()

    return in_arrow(take(docs, "text").where("text is not null"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trained(counts: list[tuple[str, int]]) -> bytes:
    """A dictionary of texts in which each word comes as often, in proportion, as in the corpus, once at least.

    The trainer gives it the statistics of single letters too, without which short
    strings are stored as they are.
    """
    total = max(1, sum(n for _, n in counts))
    drawn = [(zlib.crc32(f"{k} {w}".encode()), w) for w, n in counts for k in range(max(1, DRAWN_WORDS * n // total))]
    drawn = [w for _, w in sorted(drawn)]
    samples = [" ".join(drawn[k : k + SAMPLE_WORDS]).encode() for k in range(0, len(drawn), SAMPLE_WORDS)] + [IDENTIFIERS.encode()] * 8
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=128, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-DICTIONARY_BYTES:]


def dictionary(docs: DataFrame) -> bytes:
    """Trained on the identifiers and words that stand in most texts."""
    words = word_counts(docs).where(F.col("n") >= DICTIONARY_TEXTS)
    often = words.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(COUNTS_KEPT)
    return trained([(r.word, r.n) for r in often.collect()])


def novelties(docs: DataFrame, dictionary: bytes) -> DataFrame:
    """``step`` and ``n``: how many ordinary strings of all whole texts have a novelty of so many ``STEPS``."""

    def run(batches):
        gauge, times = Gauge(dictionary), Counter()
        for part in slices(batches, "text"):
            for t in part.column("text").to_pylist():
                times.update(int(gauge.novelty(t, a, b) * STEPS // 1) for a, b in ordinary(t))
        columns = [pa.array(times.keys(), pa.int64()), pa.array(times.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["step", "n"])

    return in_arrow(take(docs, "text").where("text is not null"), run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))


def threshold(steps: list[tuple[int, int]]) -> float:
    """The least novelty of a secret: the upper end of the step that holds the quantile."""
    above = (1 - ORDINARY_QUANTILE) * sum(n for _, n in steps)
    for step, n in sorted(steps, reverse=True):
        above -= n
        if above < 0:
            return max(LEAST_NOVELTY, (step + 1) / STEPS)
    return LEAST_NOVELTY


def fit(docs: DataFrame) -> Model:
    primed = dictionary(docs)
    return Model(primed, threshold([(r.step, r.n) for r in novelties(docs, primed).collect()]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end; by start, then kind) of every text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        gauge = Gauge(model.dictionary)
        for part in slices(batches, "text"):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(t, gauge, model.novelty)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return in_arrow(take(docs, "doc_id", "text"), run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, all spans as text, and a digest of the base spans."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(number(k) for k in KINDS),
        F.sha2(said(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their texts replaced by ``mark``; ``n_chars`` follows where there is one."""
    names = docs.columns

    def clean(text: str | None, gauge: Gauge) -> str | None:
        out, at = [], 0
        for start, _, end in scan_text(text, gauge, model.novelty):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:] if at else text

    def run(batches):
        gauge = Gauge(model.dictionary)
        for part in slices(batches, "text"):
            texts = [clean(t, gauge) for t in part.column("text").to_pylist()]
            columns = [pa.array(texts, part.schema.field("text").type) if n == "text" else part.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    cleaned = in_arrow(docs, run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cleaned
