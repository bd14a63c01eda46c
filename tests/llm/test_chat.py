"""Renderings from every speaker's view against plain Python, cut into segments of any size."""

import hashlib
import random

import pytest
from leadloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, speaker string, part int"


def frame(spark, rows):
    """Turns with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(4)


def expected(rows):
    """Whole text and mask of each conversation and speaker."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, "unknown" if role is None else role, text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.sha256(t[2].encode()).hexdigest()))
        for speaker in {r for _, r, _ in turns} - {"system"}:
            text, mask = "", []
            for _, role, said in turns:
                name = role.replace("<|", "< |").replace('"', "'")
                text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f'<|user name="{name}"|>\n'
                start = len(text)
                text += said.replace("<|", "< |") + "<|end|>\n"
                if role == speaker:
                    mask.append((start, len(text)))
            out[conv, speaker] = (text, mask, len(turns))
    return out


def odd_rows():
    rng = random.Random(6)
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "bob", "hi <|end|>"), (1, 2, 'a"n', None), (1, 2, 'a"n', None), (1, 300, "bob", "z 🙂")]
    rows += [(2, None, None, "x"), (2, None, None, "x"), (3, 1, "system", "alone"), (4, 1, "bob", "yes"), (4, None, "bob", "sure?"), (4, None, "bob", "yes")]
    rows += [(5, 0, "system", "rules")] + [(5, k, ("ann", "bob", "cy")[k % 3], f"turn {k} " + "w" * rng.randrange(40)) for k in range(1, 300)]
    rows += [(6, k, ("user", "assistant")[k % 2], f"{k}") for k in range(10_000)]
    rows += [(None, None, "bob", f"t{i}") for i in range(100)] + [(7, None, "bob", "again")] * 200 + [(8, 1, "bob", "y" * 100_000), (8, 2, "ann", "")]
    return rows


@pytest.mark.parametrize("size", [60, 5000, chat.SEGMENT_CHARS])
def test_segments_put_together_are_the_whole_dialogue(spark, size):
    rows = odd_rows() if size != 60 else [r for r in odd_rows() if r[0] != 6]
    want = expected(rows)
    found = {}
    for r in chat.perspectives(frame(spark, rows), size).collect():
        found.setdefault((r.conv_id, r.speaker), []).append(r)
    assert found.keys() == want.keys()
    for key, parts in found.items():
        parts.sort(key=lambda r: r.segment)
        text, mask, n = want[key]
        assert [r.segment for r in parts] == list(range(1, parts[0].segments + 1))
        assert "".join(r.text for r in parts) == text
        assert [tuple(m) for r in parts for m in r.mask] == mask
        assert sum(r.n_turns for r in parts) == n
        assert [r.start for r in parts] == [sum(len(q.text) for q in parts[:k]) for k in range(len(parts))]
        # the opening system turns go with every later segment
        opening = "".join(x + "<|end|>\n" for x in text.split("<|end|>\n")[:-1][: 1 if key[0] in (1, 5) else 0])
        assert [r.system for r in parts] == [""] + [opening] * (len(parts) - 1)
    if size == 60:
        assert len(found[5, "ann"]) > 50
    if size == chat.SEGMENT_CHARS:
        # a dialogue that one row holds is one segment, unless a range of the sort ends in it
        assert all(len(parts) <= 4 for parts in found.values())


def test_an_empty_table(spark):
    made = chat.digest(chat.perspectives(frame(spark, [])))
    assert made.count() == 0
