"""Chat formatting from every participant's point of view.

For each speaker of a conversation the dialogue is rendered once with that speaker
as the assistant and all others as named users; the mask holds the character
ranges the speaker is trained on: own turns, with their end marks.

The system is no speaker; its turns stay system turns.  Turns go by number, nulls
first, those of the same number by role, then by the first ``PREFIX`` characters
and a hash of the text.  A turn that occurs again is rendered again.  A null role
speaks as ``unknown``, a null text is empty, rows without conversation form one.
An empty table gives an empty table; further columns are left out.

A rendering is one text of any length.  It comes in segments of about
``SEGMENT_CHARS`` characters, most in one, cut between turns: a segment says where
in the whole text it starts, its mask counts from there as well, and later segments
repeat the system turns that open the conversation in a column of their own.

The turns are counted, then sorted over range partitions, and a task cuts its range
into segments as a stream; so a conversation that holds a third of all rows, or one
turn repeated very often, lies in many tasks.  Where a segment starts is summed up
from its number of turns and characters by role.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.functions.let import let
from leadloom.llm.shared import Staged, in_arrow, take

SEGMENT_CHARS = 1 << 20
PREFIX = 64
SYSTEM = "system"
END = "<|end|>\n"


def _plain(text: Column) -> Column:
    """Text that cannot be read as a mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROLES = pa.list_(pa.struct([("role", pa.string()), ("n", pa.int64()), ("chars", pa.int64())]))


def _ordered(turns: DataFrame, staged: Staged) -> DataFrame:
    """Each turn once with its number of copies, sorted over range partitions."""
    rows = take(turns, "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    once = once.withColumns({"opening": F.substring("text", 1, PREFIX), "said": F.sha2("text", 256)})
    # written before it is sorted: the range bounds come from a first look at the same rows
    once, _ = staged.write(once)
    order = ("conv_id", "turn", "role", "opening", "said")
    return once.repartitionByRange(*order).sortWithinPartitions(*order)


def _pieces(rows: DataFrame, segment_chars: int) -> DataFrame:
    """Neighbouring turns of one conversation, at most about ``segment_chars`` characters, in order of ``part`` and ``piece``.

    ``roles`` has turns and characters by role, ``leading`` how many system turns come first.
    """
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    schema = (
        f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, piece long, leading int, "
        "roles array<struct<role:string,n:bigint,chars:bigint>>, turns array<struct<role:string,text:string>>"
    )
    types = [kind, pa.int32(), pa.int64(), pa.int32(), _ROLES, _TURNS]
    names = ["conv_id", "part", "piece", "leading", "roles", "turns"]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        conv, turns, size = None, [], 0
        done, done_size = [], 0

        def close() -> None:
            nonlocal made, turns, size, done_size
            made += 1
            roles: dict[str, list[int]] = {}
            for t in turns:
                count = roles.setdefault(t["role"], [0, 0])
                count[0] += 1
                count[1] += len(t["text"])
            leading = next((k for k, t in enumerate(turns) if t["role"] != SYSTEM), len(turns))
            done.append([conv, part, made, leading, [{"role": r, "n": n, "chars": c} for r, (n, c) in roles.items()], turns])
            done_size += size
            turns, size = [], 0

        def batch_of() -> pa.RecordBatch:
            nonlocal done, done_size
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
            done, done_size = [], 0
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies")]
            for key, role, text, copies in zip(*columns, strict=True):
                if turns and key != conv:
                    close()
                conv = key
                text = text.replace("<|", "< |")  # as rendered, so that lengths are those of the rendering
                for _ in range(copies):
                    if turns and size + len(text) > segment_chars:
                        close()
                    turns.append({"role": role, "text": text})
                    size += len(text) + len(role) + 16
                    if done_size >= segment_chars or len(done) >= 1000:
                        yield batch_of()
        if turns:
            close()
        if done:
            yield batch_of()

    return in_arrow(rows, run, schema)


def _header(role: Column, own: Column) -> Column:
    name = F.replace(_plain(role), F.lit('"'), F.lit("'"))
    return (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(role == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit('<|user name="'), name, F.lit('"|>\n')))
    )


def perspectives(turns: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``conv_id``, ``speaker``, ``segment`` of ``segments``, ``n_turns``, ``start``, ``system``, ``text``, ``mask`` (array of start and end)."""
    staged = Staged(turns.sparkSession, "chat")
    pieces, _ = staged.write(_pieces(_ordered(turns, staged), segment_chars))
    roles = pieces.select("conv_id", F.explode("roles.role").alias("role"))
    speakers = roles.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    speakers, _ = staged.write(speakers)
    small = pieces.select("conv_id", "part", "piece", "roles").join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv")))
    rendered_chars = F.aggregate(
        "roles",
        F.lit(0).cast("long"),
        lambda a, r: a + r["chars"] + r["n"] * (F.char_length(_header(r["role"], r["role"] == F.col("speaker"))) + len(END)),
    )
    one = Window.partitionBy("conv_id", "speaker")
    before = one.orderBy("part", "piece")
    placed, _ = staged.write(
        small.select("conv_id", "speaker", "part", "piece", rendered_chars.alias("chars")).select(
            "speaker",
            "part",
            "piece",
            F.row_number().over(before).cast("long").alias("segment"),
            F.count("*").over(one).alias("segments"),
            F.coalesce(F.sum("chars").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"),
        )
    )

    def rendered(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        return F.struct(own.alias("own"), _header(t["role"], own).alias("header"), F.concat(t["text"], F.lit(END)).alias("body"))

    def masks(parts: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            start = at["end"] + F.char_length(s["header"])
            end = start + F.char_length(s["body"])
            own = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(end.alias("end"), F.when(s["own"], F.concat(at["spans"], own)).otherwise(at["spans"]).alias("spans"))

        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        return F.aggregate(parts, F.struct(F.col("start").alias("end"), none.alias("spans")), step)["spans"]

    def text_of(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda s: F.concat(s["header"], s["body"])), "")

    def whole(parts: Column) -> Column:
        return F.struct(text_of(parts).alias("text"), masks(parts).alias("mask"))

    both = placed.join(pieces.select("conv_id", "part", "piece", "turns"), ["part", "piece"])
    made = let(F.transform("turns", rendered), whole)
    made = both.select("conv_id", "speaker", "segment", "segments", F.size("turns").cast("long").alias("n_turns"), "start", made.alias("made"))
    # the system turns that open a conversation of several segments
    first = placed.where("segment = 1 and segments > 1").join(pieces, ["part", "piece"])
    opening = let(F.transform(F.slice("turns", F.lit(1), F.col("leading")), rendered), text_of)
    first = first.select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("__speaker"), opening.alias("opening"))
    later = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("speaker") == F.col("__speaker")) & (F.col("segment") > 1)
    return made.join(first, later, "left").select(
        "conv_id", "speaker", "segment", "segments", "n_turns", "start", F.coalesce("opening", F.lit("")).alias("system"), "made.text", "made.mask"
    )


def digest(made: DataFrame) -> DataFrame:
    """The mask as text, and how many characters it covers."""
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"]))
    covered = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    columns = ["conv_id", "speaker", "segment", "segments", "n_turns", "start", "system", "text"]
    return made.select(*columns, F.array_join(spans, ",").alias("mask"), covered.alias("n_trained"))


# Whole renderings: the segments of a conversation that one row holds.
ORACLE_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text)) AS i FROM turns
), speakers AS (
    SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), rendered AS (
    SELECT t.conv_id, s.speaker, t.i, t.role = s.speaker AS own,
           CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
                WHEN t.role = 'system' THEN '<|system|>' || chr(10)
                ELSE '<|user name="' || replace(replace(t.role, '<|', '< |'), '"', '''') || '"|>' || chr(10) END AS header,
           replace(t.text, '<|', '< |') || '<|end|>' || chr(10) AS body
    FROM numbered t JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM t.conv_id
), placed AS (
    SELECT *, sum(length(header) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY i) AS stop FROM rendered
)
SELECT conv_id, speaker, CAST(1 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS segments, count(*) AS n_turns, CAST(0 AS BIGINT) AS start, '' AS system,
       string_agg(header || body, '' ORDER BY i) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(body) AS VARCHAR) || '-' || CAST(stop AS VARCHAR) END, ',' ORDER BY i), '') AS mask,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_trained
FROM placed GROUP BY conv_id, speaker
"""
