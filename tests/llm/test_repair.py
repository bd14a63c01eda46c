"""Repair of conversations against exhaustive search, with blocks of any size."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from leadloom.llm import repair

TURNS = "conv_id long, turn long, role string, text string, copies string, said int"
BLANKS = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def test_trails_compare_like_strings():
    rng = random.Random(2)
    trails = repair.Trails()
    said = {0: ()}
    level = [0]
    for _ in range(40):
        after = []
        for node in level:
            for label in rng.sample(["K", "D", "IK", "ID", "IIR", "R"], 2):
                after.append(trails.add(node, label))
                said[after[-1]] = (*said[node], label)
        level = rng.sample(after, min(6, len(after)))
        for x, y in itertools.permutations(level, 2):
            assert trails.less(x, "K", y, "K") == (said[x] < said[y])
    for node in level:
        assert tuple(trails.labels(node)) == said[node]


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(repair, "MODULUS", 3)  # nearly every pair of hashes collides
    test_trails_compare_like_strings()


def all_edits(turns):
    """Every audit with its cost and turns, at most two insertions in a row."""
    ways = [("", 0, ())]
    for role, text, must_go, cut_off in turns:
        before = [
            (a + "I" * len(new), c + 3 * len(new), t + tuple((r, "") for r in new))
            for a, c, t in ways
            for new in [(), *itertools.product(["user", "assistant"], repeat=1), *itertools.product(["user", "assistant"], repeat=2)]
        ]
        ways = [(a + "D", c + 4, t) for a, c, t in before]
        if not must_go:
            ways += [(a + "K", c + 3 * cut_off, (*t, (role, text))) for a, c, t in before]
            ways += [(a + "R", c + 3 + 3 * cut_off, (*t, (new, text))) for a, c, t in before for new in ("user", "assistant")]
    return [
        (c + 3 * len(new), a + "I" * len(new), t + tuple((r, "") for r in new))
        for a, c, t in ways
        for new in [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
        if GOOD.fullmatch("".join(r[:1] for r, _ in t + tuple((r, "") for r in new)))
    ]


def test_audits_are_the_least_of_all():
    rng = random.Random(5)
    for _ in range(150):
        turns = [(rng.choice(["system", "user", "assistant", "tool", " "]), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randrange(0, 4))]
        turns = [(r, t, m, c and not m) for r, t, m, c in turns]
        block = repair.Block()
        for role, text, must_go, cut_off in turns:
            block.add(1, role, text, must_go, False, cut_off)
        [(_, cost, audit)] = block.fold(repair.FORM, True)
        best = min(all_edits(turns))
        assert (cost, audit) == best[:2]
        assert [(x["role"], x["text"]) for x in repair.apply(audit, repair.FORM, block.lines)] == list(best[2])


def expected(rows):
    """The contract on plain Python values: strings are kept whole, ties compared as strings."""
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return {conv: report(turns) for conv, turns in by.items()}


def report(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in turns:
        shown = text.strip(BLANKS)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    follows = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    names = {2: "user", 3: "assistant"}

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(2):
            for state, (cost, audit, said) in list(out.items()):
                for initial in "ua":
                    to = follows.get((initial, state))
                    if to:
                        new = (cost + 3, audit + "I", (*said, f"{names[to]}:"))
                        out[to] = min(out.get(to, new), new)
        return out

    ways = {0: (0, "", ())}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for state, (cost, audit, said) in with_inserts(ways).items():
            options = [(state, (cost + 4, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                cost += 3 * (fault == "truncated")
                if (role[:1], state) in follows:
                    options.append((follows[role[:1], state], (cost, audit + "K", (*said, f"{role}:{text}"))))
                for initial in "ua":
                    to = follows.get((initial, state))
                    if to:
                        options.append((to, (cost + 3, audit + "R", (*said, f"{names[to]}:{text}"))))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        ways = after
    cost, audit, said = min(w for s, w in with_inserts(ways).items() if s in (0, 3))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = min(2**63 - 1, max(numbers) - min(numbers) + 1 - len(set(numbers))) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def odd_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "", " \n", "cut off", "What?  ", ".", "a" * 200 + "x.", "a" * 200 + "y.", "é…", None, "late \x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "usher"]
    rows = []
    for conv in [*range(60), None]:
        rows += [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 14))]
    rows += [(500, k, ("user", "assistant")[k % 2], f"turn {k}" + "." * (k % 7 > 0)) for k in range(900)]
    rows += [(501, None, "user", "same.")] * 300
    rows += [(502, 2**63 - 1, "user", "far."), (502, -(2**63), "assistant", "apart.")]
    return rows


@pytest.mark.parametrize("size", [(3, 10**6), (10**6, 40), (repair.BLOCK_ROWS, repair.BLOCK_CHARS)])
def test_repair_equals_brute_force(spark, size):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    made = repair.repair(repair.damaged(df), "copies", *size)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.digest(made).collect()}
    want = expected(rows)
    assert found.keys() == want.keys()
    for conv in want:
        assert found[conv] == want[conv], conv


def test_repair_without_damage_and_copies(spark):
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello"), (2, None, None, None)]
    made = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)).collect()}
    assert (made[1]["audit"], made[1]["cost"], made[1]["duplicate"], made[1]["truncated"]) == ("KDK", 7, 1, 1)
    assert [tuple(x) for x in made[1]["lines"]] == [("user", "Hi."), ("assistant", "Hello")]
    assert (made[2]["audit"], made[2]["blank"], made[2]["lines"]) == ("D", 1, [])


def test_repair_of_an_empty_table(spark):
    df = repair.digest(repair.repair(repair.damaged(spark.createDataFrame([], TURNS)), "copies"))
    assert df.count() == 0
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
