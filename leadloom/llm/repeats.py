"""Substring dedup: passages that occur again, found by seeding and extending.

A window is ``WINDOW`` consecutive words of one document.  A word goes if it lies
in a window whose words also start earlier (in a document of smaller id, or
earlier in the same one); windows are judged on the input.

1. Seeds.  Every window names one anchor: the least hashed of its runs of ``SEED``
   words.  That depends on its words only, so equal windows name equal anchors at
   the same place inside them, and neighbouring windows mostly share theirs.
2. Join.  Anchors are counted over all documents; those that occur once are
   dropped.  The rest go back to their documents.
3. Extend.  An anchor left stands for the windows around it that name it, up to
   ``WINDOW - SEED`` words both ways.  They are not followed word by word against
   one other place: each window is compared with all others of the same words at
   once, by its hash together with the anchor's, one pre-aggregated least place
   per window.  No pairs are formed, so a passage in very many documents costs one
   row for each place, and no shorter match hides a longer one.
4. Overlapping windows that are not the first of their kind are joined to the
   longest repeats.

Texts travel compressed.  Null and empty texts have no words.  Documents without
an id are neither earlier nor cut.  Rows that share an id also share their
places; equal rows of one id do not repeat each other.  An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.minhash import runs, word_hashes
from leadloom.llm.shared import Staged, in_arrow, pack, slices, take, unpacked

WINDOW, SEED = 20, 6
_RANDOM = np.random.Generator(np.random.PCG64(3))
_SEED_FACTORS, _WINDOW_FACTORS = (_RANDOM.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (SEED, WINDOW))


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """How far behind each place the least of the next ``span`` values lies, the first of equal ones."""
    at, least, reach = np.arange(values.size), values, 1
    while reach < span:
        step = min(reach, span - reach)
        n = least.size - step
        better = least[step:] < least[:n]
        at, least = np.where(better, at[step:], at[:n]), np.where(better, least[step:], least[:n])
        reach += step
    return at - np.arange(at.size)


class Cut:
    """The windows of some texts, each with its place and its anchor."""

    def __init__(self, texts: list[str | None]):
        flat, self.starts = word_hashes(texts, lower=False)
        sizes = np.diff(self.starts)
        self.sizes = sizes
        windows = runs(flat, _WINDOW_FACTORS)
        seeds = runs(flat, _SEED_FACTORS)
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(flat.size) - np.repeat(self.starts[:-1], sizes)
        inside = np.flatnonzero(place[: windows.size] + WINDOW <= sizes[owner[: windows.size]]) if windows.size else np.empty(0, np.int64)
        span = WINDOW - SEED + 1
        if inside.size:
            least = leftmost_least(seeds, span)
            at = inside + least[inside]
            self.anchor = seeds[at].view(np.int64)
            opens = np.flatnonzero(np.diff(at, prepend=-1) != 0)
            self.opens = opens  # windows that name an anchor first
        else:
            self.anchor, self.opens = np.empty(0, np.int64), np.empty(0, np.int64)
        self.window = windows[inside].view(np.int64)
        self.owner, self.place = owner[inside], place[inside]


def anchors(docs: DataFrame) -> DataFrame:
    """``anchor`` and ``doc_id`` of every place that windows name."""
    schema = f"anchor long, doc_id {docs.schema['doc_id'].dataType.simpleString()}"

    def run(batches):
        for part in slices(batches, "text"):
            cut = Cut(part.column("text").to_pylist())
            ids = part.column(0).take(pa.array(cut.owner[cut.opens]))
            yield pa.RecordBatch.from_arrays([pa.array(cut.anchor[cut.opens]), ids], ["anchor", "doc_id"])

    return in_arrow(take(docs, "doc_id", "text").where("doc_id is not null"), run, schema)


def _named(cut: Cut, wanted: list[list[int] | None]) -> np.ndarray:
    """Which windows name an anchor that their document wants."""
    out = np.zeros(cut.anchor.size, bool)
    edges = np.searchsorted(cut.owner, np.arange(len(wanted) + 1))
    for k, some in enumerate(wanted):
        a, b = edges[k], edges[k + 1]
        if some and b > a:
            out[a:b] = np.isin(cut.anchor[a:b], np.array(some, np.int64))
    return out


def _windows(packed: DataFrame, repeated: DataFrame) -> DataFrame:
    """Place and hash of each window that names a repeated anchor; ``repeated`` has doc_id and anchors."""
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in unpacked(batches):
            cut = Cut(texts)
            named = np.flatnonzero(_named(cut, part.column("anchors").to_pylist()))
            ids = part.column("doc_id").take(pa.array(cut.owner[named]))
            columns = [pa.array(cut.window[named]), pa.array(cut.anchor[named].astype(np.int32)), ids, pa.array(cut.place[named].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["window", "anchor", "doc_id", "place"])

    return in_arrow(packed.join(repeated, "doc_id"), run, f"window long, anchor int, doc_id {kind}, place int")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``repeats`` (word ranges that go) and ``kept`` (the other words, joined by a space)."""
    staged = Staged(docs.sparkSession, "repeats")
    rows = take(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # read by the count and by the join: texts are cut once for both
    places, path = staged.write(anchors(rows))
    # written first: a join of two plain shuffles can have its hot anchors split
    twice, _ = staged.write(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    repeated, _ = staged.write(places.join(twice, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    staged.drop(path)
    packed, _ = staged.write(pack(rows))
    firsts = _windows(packed, repeated).groupBy("window", "anchor").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    firsts, _ = staged.write(firsts.select("first.*").groupBy("doc_id").agg(F.collect_set("place").alias("firsts")))
    marks = repeated.join(firsts, "doc_id", "left")
    schema = f"doc_id {kind}, n_words long, repeats array<struct<start:int,end:int>>, kept string"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for part, texts in unpacked(batches):
            cut = Cut(texts)
            again = _named(cut, part.column("anchors").to_pylist())
            edges = np.searchsorted(cut.owner, np.arange(len(texts) + 1))
            out, kept = [], []
            for k, first in enumerate(part.column("firsts").to_pylist()):
                a, b = edges[k], edges[k + 1]
                at = cut.place[a:b][again[a:b]]
                if first:
                    at = at[~np.isin(at, np.array(first, np.int32))]
                words = texts[k].encode().split()
                if at.size:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    out.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)])
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    out.append([])
                kept.append(b" ".join(words).decode())
            columns = [part.column("doc_id"), pa.array(cut.sizes.astype(np.int64)), pa.array(out, spans), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "repeats", "kept"])

    found = in_arrow(packed.join(marks, "doc_id", "left"), run, schema)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    nameless = rows.where("doc_id is null").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("repeats"), F.array_join(words, " ").alias("kept")
    )
    return found.unionByName(nameless)


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH cut AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents
), windows AS (
    SELECT doc_id, place, sha256(array_to_string(words[place : place + 19], ' ')) AS said
    FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS place FROM cut WHERE len(words) >= 20)
), judged AS (
    SELECT doc_id, place, row_number() OVER (PARTITION BY said ORDER BY doc_id, place) > 1 AS again FROM windows
), gone AS (
    SELECT DISTINCT doc_id, place + k AS word FROM judged, generate_series(0, 19) AS s(k) WHERE again
), kept AS (
    SELECT c.doc_id, c.word, c.text, g.word IS NOT NULL AS gone
    FROM (SELECT doc_id, generate_subscripts(words, 1) AS word, unnest(words) AS text FROM cut) c
    LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.word = c.word
), joined AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(text, ' ' ORDER BY word) FILTER (NOT gone), '') AS kept
    FROM kept GROUP BY doc_id
)
SELECT c.doc_id, CAST(len(c.words) AS BIGINT) AS n_words, coalesce(j.n_removed, 0) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN joined j ON j.doc_id = c.doc_id
"""
