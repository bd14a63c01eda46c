"""Toxicity on made-up labelled texts: single words, phrases of ordinary words, broken words."""

import random
import zlib

import pytest
from leadloom.llm import toxicity

SYLLABLES = ["la", "ve", "on", "ti", "er", "mo", "ka", "ru", "shen", "dor", "li", "nat", "pe", "zu", "gri", "bo"]


def corpus(seed, plants, n=900):
    """Texts of random words; a quarter have one of the plants, a list of words, somewhere."""
    rng = random.Random(seed)
    base = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(1500)})
    plants = plants(rng, base)
    out = []
    for _ in range(n):
        words = [rng.choice(base) for _ in range(rng.randrange(30, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            k = rng.randrange(len(words))
            words[k:k] = rng.choice(plants)
        out.append((" ".join(words), toxic))
    return out


def rates(texts):
    """Shares caught and left alone among a third of the texts, which the model has not seen."""
    seen = [x for i, x in enumerate(texts) if i % 3]
    model = toxicity.fit_texts(seen)
    scorer = model.scorer()
    found = [(label, scorer.text_margin(t) >= model.threshold) for t, label in texts[::3]]
    toxic, clean = ([f for label, f in found if label == side] for side in (1, 0))
    return sum(toxic) / len(toxic), 1 - sum(clean) / len(clean)


@pytest.mark.parametrize(
    "plants",
    [
        lambda rng, base: [["slime"], ["filth"], ["trash"], ["vermin"]],
        lambda rng, base: [rng.sample(base, 3) for _ in range(4)],
        lambda rng, base: [["sl1me"], ["f!lth"], ["tr@sh"], ["v-e-r-m-i-n"]],
    ],
    ids=["words", "phrases of ordinary words", "broken words"],
)
@pytest.mark.parametrize("seed", [1, 3])
def test_unseen_texts(plants, seed):
    caught, clean = rates(corpus(seed, plants))
    assert caught >= 0.9 and clean >= 0.98


def test_words_keep_what_is_inside():
    assert toxicity.words_of('He said: "you, id1ot!" (st*pid) -- _x_ A.B') == ["he", "said", "you", "id1ot", "st*pid", "_x_", "a.b"]
    assert toxicity.words_of(None) == toxicity.words_of(" \n!! ") == []
    pieces = toxicity.words_of("abc" * 100)
    assert all(len(p) <= toxicity.WORD_CHARS for p in pieces) and pieces[0] == ("abc" * 100)[:64] and pieces[1] == ("abc" * 100)[32:96]
    assert ("abc" * 100).endswith(pieces[-1][-40:])


def test_the_most_telling_window_of_those_inside_each_other():
    rng = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    fill = lambda: rng.sample(base, 20)
    toxic = [[*fill(), "go", "to", "mars", *fill()] for _ in range(60)]
    ordinary = [[*fill(), "go", "to", *fill()] for _ in range(60)] + [[*fill(), "to", "mars", *fill()] for _ in range(60)]
    assert toxicity.telling_windows(toxic, ordinary) == {"go to mars"}


def test_an_ordinary_word_costs_the_same_under_both():
    """Beyond 16 KB of dictionary as well."""
    rng = random.Random(4)
    texts = corpus(5, lambda r, base: [["slime"]], 1200)
    toxic, ordinary, phrase_words = toxicity.dictionaries(texts)
    assert len(ordinary) > 16_384
    scorer = toxicity.Scorer(toxic, ordinary, phrase_words)
    common = [w for t, label in texts[:300] if not label for w in t.split()]
    assert max(scorer.margin(w) for w in rng.sample(common, 400)) < 0.2 < scorer.margin("slime")


def test_labels_of_held_out_texts_are_not_learnt(spark):
    texts = corpus(6, lambda rng, base: [["slime"], ["filth"]], 600)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(texts)], "doc_id long, text string, margin string")

    def labels(turn):
        rows = [(i, 0, 1 - y if turn and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, (_, y) in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    one, two = ({r.doc_id: r for r in toxicity.classify(docs, labels(t)).collect()} for t in (False, True))
    assert {i: r.score for i, r in one.items()} == {i: r.score for i, r in two.items()}
    unseen = [(texts[i][1], r.predicted) for i, r in one.items() if r.held_out]
    assert sum(a == b for a, b in unseen) / len(unseen) > 0.97


def test_every_whole_labelled_text_is_learnt_from(spark):
    """Texts beyond 10,000 characters count like others."""
    rng = random.Random(7)
    base = ["".join(rng.choices(SYLLABLES, k=3)) for _ in range(3000)]
    texts = []
    for i in range(240):
        words = rng.choices(base, k=2000)
        texts.append(" ".join([*words[:1500], "slime", *words[1500:]] if i % 4 == 0 else words))
    assert min(map(len, texts)) > 10_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in toxicity.classify(docs, labels).collect())
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.repartition(5), labels.repartition(3))


def test_counts_of_all_texts_are_those_in_memory(spark):
    """The tasks' counts give the windows and dictionaries that the same texts give in one process."""
    texts = corpus(8, lambda rng, base: [["slime"], rng.sample(base, 3)], 500)
    staged = toxicity.Staged(spark, "test")
    rows = {label: [(i % 2, " ".join(toxicity.words_of(t))) for i, (t, y) in enumerate(texts) if y == label] for label in (1, 0)}
    made = toxicity._tallies({label: spark.createDataFrame(x, "half int, words string") for label, x in rows.items()}, staged)
    for half, tally in zip((0, 1, None), made, strict=True):
        toxic, ordinary = ([words.split(" ") for h, words in rows[label] if half in (h, None)] for label in (1, 0))
        want = toxicity._tally(toxic, ordinary)
        assert tally.texts == want.texts and tally.words == want.words
        assert tally.windows == {w: want.windows.get(w, (0, 0, tally.windows[w][2])) for w in tally.windows}
        assert tally.telling() == want.telling() != set() and tally.dictionaries() == want.dictionaries()


def test_whole_texts_are_not_moved_to_their_labels(spark, monkeypatch):
    """Whole texts leave the task that scans them only if they are labelled, cut into words; the rows are those of a join."""
    texts = corpus(9, lambda rng, base: [["slime"]], 300)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(300, texts[0][0]), (301, texts[1][0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, texts[i][1]) for i in range(0, 300, 2)] + [(0, 0, 1), (301, 0, None)], "doc_id int, quality int, toxic int")
    moved = []

    class Noted(toxicity.Staged):
        def write(self, df):
            todo = [df._jdf.queryExecution().executedPlan()]
            while todo:
                node = todo.pop()
                if "Exchange" in node.nodeName():
                    moved.append([node.output().apply(i).name() for i in range(node.output().size())])
                todo += [node.children().apply(i) for i in range(node.children().size())]
            return super().write(df)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity._labelled(docs, labels, Noted(spark, "test"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert moved and not any("text" in names for names in moved)
    want = {}
    for i in range(0, 300, 2):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            want[" ".join(toxicity.words_of(texts[i][0]))] = 1 if i == 0 else texts[i][1]
    assert {r.words: label for label, t in found.items() for r in t.collect()} == want


def test_frequent_windows_are_measured_once(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED_WINDOWS", 20)
    scorer = toxicity.Scorer(b"".join(toxicity._wide(w) for w in ("often", "slime")), toxicity._wide("often"))
    asked, ordinary = [], scorer.ordinary

    class Counted:
        def compress(self, data):
            asked.append(data)
            return ordinary.compress(data)

    scorer.ordinary = Counted()
    margins = {scorer.margin(w) for k in range(50) for w in (f"rare{k}", "often")}
    assert len(asked) == 51 and len(scorer.known) + len(scorer.before) <= 20 and len(margins) >= 1
