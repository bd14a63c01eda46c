"""Near-duplicates by one-permutation hashing.

1. A document's set is its distinct word shingles, as 64-bit hashes.  One
   permutation deals them into ``BINS`` bins; an empty bin copies the bin that
   comes first in an order of its own (optimal densification).  Bands of bins
   give the buckets; ``BANDS`` has their number and rows for each similarity.
2. Documents with equal sets are one class, with its least id as representative.
   Only representatives go on.
3. Buckets are worked on in stars, whose centre is the member that shares most
   buckets.  First each document is compared, on the full sets, with the one
   centre that shares most; that joins most groups.  Then, in ``STAR_ROUNDS``
   rounds, each centre is compared with the members of other components and
   leaves its bucket.  Buckets whose members are all in one component are done.
   So the number of pairs grows with the members, not their square.
4. What is left, members of buckets that still hold several components, is
   compared exactly by prefix filtering: similar sets share one of the rarest
   shingles of each, and what follows its first place must suffice for the rest.

``op9_minhash`` links from a similarity of 0.85 on, the stage of the pipeline from
0.8 on.  At either a pair shares no bucket with a chance below one in a million;
there is no cap on members or candidates.

Null and empty texts have the empty set and are linked with nothing.  Documents
without an id are kept and linked with nothing.  Rows of the same id are one
document in links.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.components import components
from leadloom.llm.shared import Staged, in_arrow, pack, slices, take, unpacked
from leadloom.operators.keys import key_filter

SHINGLE = 5
BINS = 192
SIMILAR, STAGE_SIMILAR, OF = 85, 80, 100
#: Bands and rows: (1 - 0.85^6)^32 is 6e-8 and (1 - 0.8^5)^38 is 3e-7; 32 x 6 would miss 6e-5 at 0.8.
BANDS = {SIMILAR: (32, 6), STAGE_SIMILAR: (38, 5)}
STAR_ROUNDS = 2

_RANDOM = np.random.Generator(np.random.PCG64(9))
_WORD_FACTORS = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _RANDOM.integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = _RANDOM.random((BINS, BINS))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, flat, and where each text starts.  Only A-Z are lowered."""
    cut = [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in texts]
    words = [w for one in cut for w in one]
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    flat = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return flat, np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])


def runs(flat: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``len(factors)`` neighbouring values."""
    n = flat.size - len(factors) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, f in enumerate(factors):
        total += flat[k : k + n] * f
    return mixed(total)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, starts = word_hashes(texts, lower=True)
    shingles = runs(flat, _WORD_FACTORS)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(shingles[a : b - SHINGLE + 1]))
        elif b > a:
            whole = flat[a:b]
            out.append(runs(whole, _WORD_FACTORS[: b - a]) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each bin; empty bins densified.  ``shingles`` is sorted and not empty."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
    filled = bins[first].astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    out[filled] = shingles[first]
    if filled.size < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled)
        out[empty] = out[filled[np.argmin(_ORDERS[np.ix_(empty, filled)], axis=1)]]
    return out


def bands(sign: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    n, rows = BANDS[similar]
    grid = sign[: n * rows].reshape(n, rows)
    return mixed((grid * _BAND_FACTORS[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64))


def sketches(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``same`` (a digest of the set, null if empty) and its ``bands``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, same string, bands array<long>"

    def run(batches):
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist())
            same = [xxhash.xxh3_128_hexdigest(s.tobytes()) if s.size else None for s in sets]
            keys = [bands(signature(s), similar).view(np.int64) if s.size else [] for s in sets]
            columns = [part.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(same, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "same", "bands"])

    return in_arrow(take(docs, "doc_id", "text"), run, schema)


def sets_of(packed: DataFrame) -> DataFrame:
    """``id`` and its sorted ``shingles`` of packed texts."""
    schema = f"id {packed.schema['doc_id'].dataType.simpleString()}, shingles array<long>"

    def run(batches):
        for part, texts in unpacked(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return in_arrow(packed, run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("all"))
    return counted.where(OF * F.col("common") >= similar * F.col("all")).select("a", "b")


def _stars(members: DataFrame, staged: Staged) -> DataFrame:
    """Each member of a bucket with its centre, the centre's size and how much it shares.

    The centres are written first: a join of two plain shuffles can have the members
    of a hot bucket split.
    """
    centres = members.groupBy("bucket").agg(F.max(F.struct("shared", -F.col("id"), "n")).alias("top"))
    centres = centres.select("bucket", (-F.col("top.col2")).alias("centre"), F.col("top.n").alias("centre_n"), F.col("top.shared").alias("centre_shared"))
    return members.join(staged.write(centres)[0], "bucket")


def _ordered(pairs: DataFrame, similar: int) -> DataFrame:
    """Pairs whose sizes allow the similarity, the lesser id first, once each."""
    fits = OF * F.least("n", "centre_n") >= similar * F.greatest("n", "centre_n")
    return pairs.where(fits & (F.col("id") != F.col("centre"))).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _hubs(members: DataFrame, similar: int, staged: Staged) -> DataFrame:
    """Each id with the one centre, of all its buckets, that shares most."""
    best = _stars(members, staged).where("id <> centre").groupBy("id", "n").agg(F.max(F.struct("centre_shared", -F.col("centre"), "centre_n")).alias("top"))
    return _ordered(best.select("id", "n", (-F.col("top.col2")).alias("centre"), F.col("top.centre_n").alias("centre_n")), similar)


def _open(members: DataFrame, labels: DataFrame | None, staged: Staged) -> DataFrame:
    """The members of buckets that still hold several components, with their component."""
    members = members.select("bucket", "id", "n", "shared")
    if labels is not None:
        members = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    else:
        members = members.withColumn("component", F.col("id"))
    members, _ = staged.write(members)
    several = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return members.join(staged.write(several)[0], "bucket")


def _rest(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """All pairs of different components among the members that can be similar.

    Shingles are ranked from the rarest on.  Sets of similarity s have at least
    s n shingles in common, so they meet within the first (1 - s) n + 1 of each; at
    their first common shingle, what is not before it must hold all common ones.
    """
    ids = members.select("id", "n", "component").distinct()
    each = sets.join(ids.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
    met = each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    ranked = each.join(met, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("ranked"))
    alone = F.col("n") - F.size("ranked")  # these come first and meet nothing
    prefix = F.col("n") - F.floor((similar * F.col("n") + OF - 1) / OF) + 1
    head = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))
    heads = ids.join(ranked, "id").select("id", "n", "component", alone.alias("alone"), F.posexplode(head).alias("place", "at"))
    heads = heads.select("id", "n", "component", (F.col("n") - F.col("alone") - F.col("place")).alias("rest"), F.col("at.shingle").alias("shingle"))
    other = heads.select("shingle", F.col("id").alias("centre"), F.col("n").alias("centre_n"), F.col("component").alias("centre_component"), F.col("rest").alias("centre_rest"))
    can = (OF + similar) * F.least("rest", "centre_rest") >= similar * (F.col("n") + F.col("centre_n"))
    return _ordered(heads.join(other, "shingle").where("id < centre and component <> centre_component").where(can), similar)


def links(members: DataFrame, sets: DataFrame, staged: Staged, similar: int = SIMILAR) -> DataFrame | None:
    """``node`` and ``component`` of all ids that are linked; ``members`` has bucket, id, n and shared."""
    found, labels = [], None

    def test(pairs: DataFrame) -> None:
        nonlocal labels
        more, _ = staged.write(confirmed(pairs, sets, similar))
        if not more.isEmpty():
            found.append(more)
            labels = components(reduce(DataFrame.unionByName, found), staged)

    test(_hubs(members, similar, staged))
    for _ in range(STAR_ROUNDS):
        members, _ = staged.write(_open(members, labels, staged))
        if members.isEmpty():
            return labels
        stars, _ = staged.write(_stars(members, staged))
        own, _ = staged.write(stars.where("id = centre").select("bucket", F.col("component").alias("centre_component")))
        test(_ordered(stars.join(own, "bucket").where("component <> centre_component"), similar))
        members = stars.where("id <> centre")
    members, _ = staged.write(_open(members, labels, staged))
    if not members.isEmpty():
        test(_rest(members, sets, similar))
    return labels


def classes(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each document; linked from ``similar`` of 100 on."""
    staged = Staged(docs.sparkSession, "minhash")
    rows, _ = staged.write(sketches(docs, similar))
    named = rows.where("doc_id is not null and same is not null")
    # written first: the join below can have a large group of copies split
    alike, _ = staged.write(named.groupBy("same").agg(F.min("doc_id").alias("first")))
    # one row per set; a set's bands are the same in every copy
    firsts = named.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = firsts.select(F.explode("bands").alias("bucket"), "id", "n")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = members.join(staged.write(sizes)[0], "bucket")
    shared = members.groupBy("id").agg(F.sum("size").alias("shared"))
    members, _ = staged.write(members.select("bucket", "id", "n").join(shared, "id"))
    wanted, _ = staged.write(members.select(F.col("id").alias("doc_id")).distinct())
    # most texts share no bucket: they are left out where they are scanned, before any are moved
    asked = docs.where(key_filter(wanted, ["doc_id"])(F.col("doc_id")))
    sets, _ = staged.write(sets_of(pack(asked).join(wanted, "doc_id", "left_semi")).dropDuplicates(["id"]))
    labels = links(members, sets, staged, similar)
    result = rows.select("doc_id", "n_shingles", "same").join(alike, "same", "left")
    if labels is None:
        component = F.coalesce("first", "doc_id")
    else:
        result = result.join(labels.withColumnRenamed("node", "first"), "first", "left")
        component = F.coalesce("component", "first", "doc_id")
    result = result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, similar: int = STAGE_SIMILAR) -> DataFrame:
    """One document of each group, with all its columns; of rows with one id, all or none."""
    gone = classes(docs, similar).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
