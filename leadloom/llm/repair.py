"""Structure repair of conversations, with the cheapest audit of edits.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``:
an optional system turn, then user and assistant in turn; it may be empty.  Each
turn is kept (0), given the role user or assistant (3) or deleted (4, and always if
it is blank or repeats an earlier role and text); turns that are cut off add 3
unless deleted; empty user or assistant turns may be inserted anywhere (3).  The
audit is the edits' initials (K, R, D, I) in order; of equally cheap ones the least
in ASCII counts.

1. Equal turns are counted before anything is sorted, so that one repeated very
   often is one row.  What repeats an earlier turn is found by an aggregate.
2. The turns are sorted by conversation and turn over range partitions, so one that
   holds a third of all rows spans many.  A task reads its range as a stream in
   blocks of bounded size, and folds each block over four states of the role
   pattern (nothing yet, after s, after u, after a).
3. The fold keeps the cheapest audit of each state as a node of a persistent tree:
   prefixes are shared, a node knows its ancestors at powers of two and a rolling
   hash of its labels.  A tie is decided by searching the longest common prefix of
   the two along their ancestors; what the hashes call equal is verified.  Audits of
   equal cost and place never are prefixes of each other (they would differ by
   inserted turns only, and so in cost), so the lesser one stays the lesser whatever
   follows, and folding block by block is exact.
4. A conversation inside one block is done there.  Of others each block gives its
   cheapest audits from each state to each state; these small summaries are folded
   in order with the same tree, and the blocks are then repaired side by side.

Conversations follow any order; turns go by number, nulls first, those of the same
number by role, then by the first ``PREFIX`` characters and a hash of the text.  Null
roles and texts are one space.  Rows without a conversation form one.  Empty texts
are blank.  A role is known by its first character.  An empty table gives an empty
table.  Gaps beyond a long stay at its bound.  Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.shared import Staged, in_arrow, take

BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
PREFIX = 64
RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FORM, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"s": {FORM: SYSTEM}, "u": {FORM: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Turns inserted before an edit, and the state they lead to; longer runs only add cost.
INSERTED = {
    FORM: [(FORM, ""), (USER, "I"), (ASSISTANT, "II")],
    SYSTEM: [(SYSTEM, ""), (USER, "I"), (ASSISTANT, "II")],
    USER: [(USER, ""), (ASSISTANT, "I")],
    ASSISTANT: [(ASSISTANT, ""), (USER, "I")],
}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
MOST = 2**63 - 1

LINES = "array<struct<role:string,text:string>>"
_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal")

#: A step of the fold: from each state the states it leads to, at what cost, with what label.
Step = dict[int, list[tuple[int, int, str]]]
Best = dict[int, tuple[int, int]]


class Trails:
    """Persistent label sequences: nodes that share their prefixes."""

    def __init__(self):
        self.parent, self.label, self.hash, self.above = [0], [""], [1], [()]

    def add(self, parent: int, label: str) -> int:
        """``parent`` with one label more."""
        above, up = self.above, [parent]
        while len(up) <= len(above[up[-1]]):
            up.append(above[up[-1]][len(up) - 1])
        self.parent.append(parent)
        self.label.append(label)
        self.hash.append((self.hash[parent] * BASE + xxhash.xxh64_intdigest(label) + 1) % MODULUS)
        above.append(tuple(up))
        return len(self.parent) - 1

    def labels(self, node: int, until: int = 0) -> list[str]:
        out = []
        while node != until:
            out.append(self.label[node])
            node = self.parent[node]
        return out[::-1]

    def _equal(self, x: int, y: int) -> bool:
        """Whether two sequences of one length really are equal; shared prefixes end the walk."""
        while x != y:
            if self.label[x] != self.label[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def less(self, x: int, x_next: str, y: int, y_next: str) -> bool:
        """Whether ``x`` and then ``x_next`` reads before ``y`` and then ``y_next``; x and y are of one length."""
        if self.hash[x] == self.hash[y]:
            if self._equal(x, y):
                return x_next < y_next
            return self._plainly(x, y)
        at_x, at_y = x, y
        for k in reversed(range(len(self.above[x]))):
            if k < len(self.above[at_x]):
                up_x, up_y = self.above[at_x][k], self.above[at_y][k]
                if self.hash[up_x] != self.hash[up_y]:
                    at_x, at_y = up_x, up_y
        if self._equal(self.parent[at_x], self.parent[at_y]):
            return self.label[at_x] < self.label[at_y]
        return self._plainly(x, y)

    def _plainly(self, x: int, y: int) -> bool:
        """For sequences whose prefixes collided."""
        return self.labels(x) < self.labels(y)


def advance(trails: Trails, best: Best, step: Step) -> Best:
    """The cheapest, then least, trail of each state after one step."""
    after: dict[int, tuple[int, int, str]] = {}
    for state, (cost, node) in best.items():
        for to, more, label in step.get(state, ()):
            held = after.get(to)
            if held is None or cost + more < held[0] or (cost + more == held[0] and trails.less(node, label, held[1], held[2])):
                after[to] = (cost + more, node, label)
    return {to: (cost, trails.add(node, label)) for to, (cost, node, label) in after.items()}


def _turn_step(initial: str, must_go: bool, cut_off: bool) -> Step:
    """All edits of one turn, with the turns inserted before it; the best one for each pair of states."""
    out: Step = {}
    for start, inserted in INSERTED.items():
        best: dict[int, tuple[int, str]] = {}
        for state, marks in inserted:
            more = INSERT * len(marks)
            edits = [(state, more + DELETE, marks + "D")]
            if not must_go:
                more += CUT_OFF * cut_off
                if state in FOLLOWS.get(initial, {}):
                    edits.append((FOLLOWS[initial][state], more, marks + "K"))
                edits += [(FOLLOWS[new][state], more + RETYPE, marks + "R") for new in "ua" if state in FOLLOWS[new]]
            for to, cost, label in edits:
                best[to] = min(best.get(to, (cost, label)), (cost, label))
        out[start] = [(to, cost, label) for to, (cost, label) in best.items()]
    return out


STEPS = {(i, m, c): _turn_step(i, m, c) for i in ("s", "u", "a", "") for m in (False, True) for c in (False, True)}
#: What closes a conversation: it ends empty or after an assistant.
CLOSE: Step = {FORM: [(FORM, 0, "")], ASSISTANT: [(FORM, 0, "")], USER: [(FORM, INSERT, "I")], SYSTEM: [(FORM, 2 * INSERT, "II")]}


def apply(audit: str, state: int, turns: list[dict]) -> list[dict]:
    """The turns that edits leave, from a state on."""
    out, rest = [], iter(turns)
    for edit in audit:
        if edit == "I":
            state = ASSISTANT if state == USER else USER
            out.append({"role": NAMES[state], "text": ""})
            continue
        turn = next(rest)
        if edit == "K":
            state = FOLLOWS[turn["role"][:1]][state]
            out.append(turn)
        elif edit == "R":
            state = ASSISTANT if state == USER else USER
            out.append({"role": NAMES[state], "text": turn["text"]})
    return out


@dataclass
class Block:
    """Some neighbouring turns of one conversation."""

    lines: list[dict] = field(default_factory=list)
    kinds: list[tuple[str, bool, bool]] = field(default_factory=list)
    chars: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        if self.lines and self.lines[-1]["role"][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.lines.append({"role": role, "text": text})
        self.kinds.append((role[:1] if role[:1] in FOLLOWS else "", fault in ("blank", "duplicate"), fault == "truncated"))
        self.chars += len(role) + len(text)

    def fold(self, start: int, close: bool) -> list[tuple[int, int, str]]:
        """End state, cost and audit of the cheapest ways through the block."""
        trails, best = Trails(), {start: (0, 0)}
        for kind in self.kinds:
            best = advance(trails, best, STEPS[kind])
        if close:
            best = advance(trails, best, CLOSE)
        return [(end, cost, "".join(trails.labels(node))) for end, (cost, node) in best.items()]


@dataclass
class Total:
    """The counts of blocks read in order."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    low: int | None = None
    high: int | None = None
    turns: int = 0
    last: str | None = None

    def add(self, counts: dict[str, int], low: int | None, high: int | None, turns: int, first: str | None, last: str | None) -> None:
        for name, n in counts.items():
            self.counts[name] += n
        if first is not None:
            if self.last is not None and self.last + first not in LEGAL:
                self.counts["illegal"] += 1
            self.last = last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults made by a hash of conversation and turn; ``copies`` is how often a turn occurs, 0 if it was dropped."""
    rows = take(turns, "conv_id", "turn", "role", "text")
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *spelled).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("fate", fate).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def _judged(turns: DataFrame, copies: str | None, staged: Staged) -> DataFrame:
    """Each turn once, with its number of copies and its faults; turns of 0 copies only name their conversation."""
    times = F.col(f"`{copies}`") if copies else F.lit(1)
    here = times > 0
    rows = turns.select(
        "conv_id",
        here.alias("here"),
        F.when(here, F.col("turn")).cast("long").alias("turn"),
        F.when(here, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
        F.when(here, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"),
        times.cast("long").alias("copies"),
    )
    once = rows.groupBy("conv_id", "here", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    once = once.withColumn("said", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    once, _ = staged.write(once)
    repeated = once.where("here").groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("words")).agg(
        F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")
    )
    repeated = repeated.where("n > 1").drop("n")
    joined = once.join(repeated, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("words")), "left")
    return joined.select(
        "conv_id", "turn", "role", "text", "copies", "said",
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )


def _summaries(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Blocks of the sorted rows; conversations known to lie inside one block are repaired."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = (
        f"conv_id {kind}, part int, block long, whole boolean, paths array<struct<start:int,end:int,cost:long,audit:string>>, {counts}, "
        f"first string, last string, low long, high long, turns long, lines {LINES}"
    )
    names = ["conv_id", "part", "block", "whole", "paths", *COUNTS, "first", "last", "low", "high", "turns", "lines"]
    types = [_arrow_type(rows, "conv_id"), pa.int32(), pa.int64(), pa.bool_(), _PATHS, *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, _LINES]

    def run(batches):
        part = TaskContext.get().partitionId()
        made = 0

        def piece(conv, block: Block, opens: bool) -> list:
            starts = (FORM,) if opens else (FORM, SYSTEM, USER, ASSISTANT)
            paths = [{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, c, a in block.fold(s, False)]
            return row(conv, block, False, paths, block.lines)

        def whole(conv, block: Block) -> list:
            [(end, cost, audit)] = block.fold(FORM, True)
            return row(conv, block, True, [{"start": FORM, "end": end, "cost": cost, "audit": audit}], apply(audit, FORM, block.lines))

        def row(conv, block: Block, done: bool, paths: list, lines: list) -> list:
            nonlocal made
            made += 1
            first, last = (block.lines[0]["role"][:1], block.lines[-1]["role"][:1]) if block.lines else (None, None)
            return [conv, part, made, done, paths, *block.counts.values(), first, last, block.low, block.high, block.turns, lines]

        def blocks() -> Iterator[list]:
            conv, block, cut, opens = None, None, True, False  # the first conversation of a range may have begun before it
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again", "blank", "truncated")]
                for key, turn, role, text, copies, again, blank, truncated in zip(*columns, strict=True):
                    if block is None:
                        conv, block = key, Block()
                    elif key != conv:
                        yield piece(conv, block, opens) if cut else whole(conv, block)
                        conv, block, cut, opens = key, Block(), False, True
                    for k in range(copies):
                        if block.lines and (len(block.lines) >= block_rows or block.chars >= block_chars):
                            yield piece(conv, block, opens)
                            block, cut, opens = Block(), True, False
                        block.add(turn, role, text, blank, again or k > 0, truncated)
            if block is not None:  # the last one may go on in the next range
                yield piece(conv, block, opens)

        for some in _groups(blocks(), block_rows, block_chars):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate(types)], names)

    return in_arrow(rows, run, schema)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def _groups(rows: Iterator[list], most: int, chars: int) -> Iterator[list[list]]:
    """Rows in lists of bounded size; the last field of a row holds its lines."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(x["text"]) for x in row[-1])
        if len(some) >= most or size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def _chosen(pieces: DataFrame) -> DataFrame:
    """Start state and audit of each block of the conversations that were cut, with the counts of the whole."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", *COUNTS, "cost")
    schema = f"conv_id {kind}, part int, block long, segment long, segments long, start int, audit string, {', '.join(f'{c} long' for c in counts)}"
    types = [_arrow_type(pieces, "conv_id"), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.string(), *[pa.int64()] * len(counts)]
    names = ["conv_id", "part", "block", "segment", "segments", "start", "audit", *counts]

    def run(batches):
        conv, places, trails, best, total = None, [], Trails(), {}, Total()

        def close() -> list[list]:
            [(cost, node)] = advance(trails, best, CLOSE).values()
            audits = trails.labels(node)
            audits = [*audits[:-2], audits[-2] + audits[-1]]
            # the states on the way are read off the audits themselves
            out, state = [], FORM
            for k, ((part, block, ends), audit) in enumerate(zip(places, audits, strict=True)):
                out.append([conv, part, block, k + 1, len(places), state, audit, total.gaps, *total.counts.values(), cost])
                state = next((e for s, e, a in ends if s == state and a == audit), None)
            return out

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(types))], names)

        for batch in batches:
            for r in batch.to_pylist():
                if places and r["conv_id"] != conv:
                    yield batch_of(close())
                    places, trails, best, total = [], Trails(), {}, Total()
                if not places:
                    conv, best = r["conv_id"], {FORM: (0, 0)}
                step: Step = {}
                for p in r["paths"]:
                    step.setdefault(p["start"], []).append((p["end"], p["cost"], p["audit"]))
                best = advance(trails, best, step)
                total.add({c: r[c] for c in COUNTS}, r["low"], r["high"], r["turns"], r["first"], r["last"])
                places.append((r["part"], r["block"], [(p["start"], p["end"], p["audit"]) for p in r["paths"]]))
        if places:
            yield batch_of(close())

    ordered = pieces.drop("lines").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return in_arrow(ordered, run, schema)


def _repaired(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """The blocks of cut conversations with their edits applied, each where it lies."""
    joined = chosen.join(pieces.select("part", "block", "lines"), ["part", "block"]).select(*chosen.columns, "lines")
    at = joined.columns.index("lines")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                lines = apply(r.column("audit")[0].as_py(), r.column("start")[0].as_py(), r.column("lines")[0].as_py())
                yield r.set_column(at, "lines", pa.array([lines], _LINES))

    return in_arrow(joined, run, joined.schema)


def repair(turns: DataFrame, copies: str | None = None, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Repaired conversations: ``conv_id``, ``segment`` of ``segments``, ``audit``, ``lines`` (role and text) and the counts of the whole.

    A conversation of any length comes in segments of bounded size, most in one.
    ``copies`` may name a column that says how often a turn occurs; a turn of 0
    copies only names its conversation, which then is in the result without turns.
    """
    staged = Staged(turns.sparkSession, "repair")
    rows = _judged(take(turns, "conv_id", "turn", "role", "text", *([copies] if copies else [])), copies, staged)
    # written before it is sorted: the range bounds come from a first look at the same rows
    rows, _ = staged.write(rows.withColumn("opening", F.substring("text", 1, PREFIX)))
    order = ("conv_id", "turn", "role", "opening", "said")
    blocks, _ = staged.write(_summaries(rows.repartitionByRange(*order).sortWithinPartitions(*order), block_rows, block_chars))
    counts = ["gaps", *COUNTS, "cost"]
    gaps = F.expr(f"if(high is null, 0, least(cast(high as decimal(20,0)) - low + 1 - turns, {MOST}))")
    path = F.col("paths")[0]
    done = blocks.where("whole").select(
        "conv_id", F.lit(1).cast("long").alias("segment"), F.lit(1).cast("long").alias("segments"), path["audit"].alias("audit"), "lines",
        gaps.cast("long").alias("gaps"), *COUNTS, path["cost"].alias("cost"),
    )
    pieces = blocks.where("not whole")
    # read by the join below and again by the query: the fold of the summaries runs once
    chosen, _ = staged.write(_chosen(pieces))
    cut = _repaired(pieces, chosen).select("conv_id", "segment", "segments", "audit", "lines", *counts)
    return done.unionByName(cut)


def digest(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: counts, audit, and the SHA-256 of its repaired turns.

    Such a digest is made from start to end, so conversations of several segments
    pass through one task each, as a stream.
    """
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    names = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    single = repaired.where("segments = 1").withColumn("repaired_sha256", F.sha2(text, 256)).select(*names)
    long_ = repaired.where("segments > 1").withColumn("empty", F.size("lines") == 0).withColumn("lines", text)
    schema = single.schema

    def run(batches):
        conv, first, sha, audits, begun = None, None, None, [], False

        def row() -> pa.RecordBatch:
            out = first.append_column("sha", pa.array([sha.hexdigest()]))
            out = out.set_column(out.schema.names.index("audit"), "audit", pa.array(["".join(audits)]))
            return out.select(["conv_id", "gaps", *COUNTS, "cost", "audit", "sha"]).rename_columns(names)

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                if r.column("segment")[0].as_py() == 1:
                    if first is not None:
                        yield row()
                    first, sha, audits, begun = r, hashlib.sha256(), [], False
                audits.append(r.column("audit")[0].as_py())
                if not r.column("empty")[0].as_py():
                    sha.update((("\n" if begun else "") + r.column("lines")[0].as_py()).encode())
                    begun = True
        if first is not None:
            yield row()

    ordered = long_.select("conv_id", "segment", "audit", "lines", "empty", "gaps", *COUNTS, "cost").repartition("conv_id")
    return single.unionByName(in_arrow(ordered.sortWithinPartitions("conv_id", "segment"), run, schema))


ORACLE_SQL = r"""
WITH RECURSIVE spelled AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spelled
    FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(
               list_concat([4294967295], list_transform(string_split(spelled, ''), lambda c: CAST(unicode(c) AS BIGINT))),
               lambda crc, byte: list_reduce(
                   [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 20 AS fate
    FROM spelled
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(generate_series(1, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE fate <> 0
), numbered AS (
    SELECT *, row_number() OVER (
               PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(length(role) || ':' || role || text)) AS i
    FROM damaged
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
    FROM numbered
), inserted(state, marks, middle, lines) AS (
    VALUES (0, '', 0, ''), (0, 'I', 2, '+user:'), (0, 'II', 3, '+user:+assistant:'),
           (1, '', 1, ''), (1, 'I', 2, '+user:'), (1, 'II', 3, '+user:+assistant:'),
           (2, '', 2, ''), (2, 'I', 3, '+assistant:'), (3, '', 3, ''), (3, 'I', 2, '+user:')
), edits(edit, initial, state, after, cost, role) AS (
    VALUES ('D', NULL, 0, 0, 4, NULL), ('D', NULL, 1, 1, 4, NULL), ('D', NULL, 2, 2, 4, NULL), ('D', NULL, 3, 3, 4, NULL),
           ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
           ('R', NULL, 0, 2, 3, 'user'), ('R', NULL, 1, 2, 3, 'user'), ('R', NULL, 3, 2, 3, 'user'), ('R', NULL, 2, 3, 3, 'assistant')
), walk AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''} AS best FROM conversations
    UNION ALL
    SELECT conv_id, i, state, best FROM (
        SELECT w.conv_id, f.i, e.after AS state, min({
                   'cost': CAST(w.best.cost + 3 * length(n.marks) + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT),
                   'audit': w.best.audit || n.marks || e.edit,
                   'said': w.best.said || replace(n.lines, '+', chr(10)) || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, f.role) || ':' || f.text END}) AS best
        FROM walk w
        JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
        JOIN inserted n ON n.state = w.state
        JOIN edits e ON e.state = n.middle AND (e.edit = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (e.initial IS NULL OR e.initial = substr(f.role, 1, 1))
        GROUP BY w.conv_id, f.i, e.after
    )
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), ended AS (
    SELECT w.conv_id, any_value(c.gaps) AS gaps, any_value(c.blank) AS blank, any_value(c.duplicate) AS duplicate,
           any_value(c.truncated) AS truncated, any_value(c.illegal) AS illegal,
           min({'cost': w.best.cost + 3 * length(n.marks), 'audit': w.best.audit || n.marks, 'said': w.best.said || replace(n.lines, '+', chr(10))}) AS best
    FROM walk w
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
    JOIN inserted n ON n.state = w.state AND n.middle IN (0, 3)
    WHERE w.i = coalesce(c.n, 0)
    GROUP BY w.conv_id
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
FROM ended
"""
