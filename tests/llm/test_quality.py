"""The quality classifier: against plain numpy, on held-out labels and on odd inputs."""

import random
import zlib

import numpy as np
import pytest
from leadloom.llm import quality

DOCS = "doc_id long, text string, lang string, fold string, stats int, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def prose(rng, n):
    return " ".join(rng.choice(["la", "ve", "on", "ti", "er"]) + rng.choice(["ka", "mo", "ru", "shen", "dor"]) + rng.choice(["", "s", ".", ","]) for _ in range(n))


def poor(rng, n):
    text = prose(rng, n)
    return rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), "the " * n, " ".join(w + "&&&" for w in text.split())])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    made = [(i, int(rng.random() < 0.7)) for i in range(1500)]
    return [(i, (prose if q else poor)(rng, rng.randrange(20, 200)), q) for i, q in made]


def frames(spark, rows, labels):
    return (
        spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in rows], DOCS).repartition(4),
        spark.createDataFrame([(i, q, 0, "z") for i, q in labels], LABELS),
    )


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_labels(spark, corpus):
    docs, labels = frames(spark, [(i, t) for i, t, _ in corpus], [(i, q) for i, _, q in corpus])
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(found[i]["held_out"] == is_held_out(i) for i, _, _ in corpus)
    unseen = [(q, found[i]["predicted"]) for i, _, q in corpus if is_held_out(i)]
    for q in (0, 1):
        right = [p == q for label, p in unseen if label == q]
        assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())


def test_held_out_labels_are_not_learnt(spark, corpus):
    turned = [(i, 1 - q if is_held_out(i) else q) for i, _, q in corpus]
    docs, labels = frames(spark, [(i, t) for i, t, _ in corpus], [(i, q) for i, _, q in corpus])
    _, others = frames(spark, [], turned)
    one, two = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, others))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_densities_equal_plain_numpy(spark, corpus):
    stats = np.array([quality.statistics(t) for _, t, _ in corpus])
    label = np.array([q for _, _, q in corpus])
    rows = spark.createDataFrame([(int(i % quality.FOLDS), int(q), [float(v) for v in s]) for i, (q, s) in enumerate(zip(label, stats, strict=True))], "fold int, quality int, stats array<double>")
    model = quality.fit(rows.repartition(3))
    z = (stats - stats.mean(axis=0)) / stats.std(axis=0)
    both = sum(np.cov(z[label == c].T, bias=True) * (label == c).mean() for c in (0, 1))

    def density(c, pooled, rounded):
        s = (1 - pooled) * np.cov(z[label == c].T, bias=True) + pooled * both
        s = (1 - rounded) * s + rounded * (np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
        away = z - z[label == c].mean(axis=0)
        return np.log((label == c).mean()) - np.linalg.slogdet(s)[1] / 2 - (away * np.linalg.solve(s, away.T).T).sum(axis=1) / 2

    found = np.sinh(model.difference(stats))
    wanted = [density(1, p, r) - density(0, p, r) for p in quality.POOLED for r in quality.ROUND]
    assert min(np.abs(found - w).max() / np.abs(w).max() for w in wanted) < 1e-8


def test_odd_documents(spark, corpus):
    odd = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "x" * 200_000), (9004, "漢字🙂" * 50), (None, "no id here"), (3, corpus[3][1]), (9005, corpus[3][1])]
    rows = [(i, t) for i, t, _ in corpus] + odd
    labels = [(i, q) for i, _, q in corpus] + [(None, 1), (9001, None), (3, corpus[3][2]), (77777, 0)]
    docs, marks = frames(spark, rows, labels)
    found = quality.classify(docs, marks).collect()
    assert len(found) == len(rows)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in found)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[3][0] == by[3][1] == by[9005][0]
    assert by[9000] == by[9001]
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]


def test_without_classes(spark):
    for labels in ([], [(1, 1), (2, 1)], [(1, 0)]):
        docs, marks = frames(spark, [(1, "one two"), (2, None)], labels)
        known = [q for i, q in labels if not is_held_out(i)]
        share = (sum(known) + 1) / (len(known) + 2)
        assert [r["score"] for r in quality.classify(docs, marks).collect()] == [share, share]
    docs, marks = frames(spark, [], [(1, 1), (2, 0)])
    assert quality.classify(docs, marks).count() == 0
