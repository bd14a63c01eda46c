"""The corpus operators against brute force, and on odd inputs."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from leadloom.llm import chat, minhash, mixing, pieces, queries, repeats, rules, secrets, toxicity, urltree, vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, words int, bucket string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, None) for i, t, lang, source in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["la", "ve", "on", "ti", "er"]) + rng.choice(["ka", "mo", "ru", "shen", "dor"]) + rng.choice(["", "s", "li", "nat"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and very long texts, repeated rows, near copies and shared passages."""
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(30, 120)) for _ in range(25)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(base)]
    rows += [(100 + i, base[3].replace(base[3].split()[40 % len(base[3].split())], f"new{i}", 1), "en", "s0") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, "one two", "en", "s1"), (203, " \n\t ", "en", "s1"), (204, "one two", "en", "s1")]
    rows += [(300, prose(rng, 20_000), "en", "s2"), (301, "x" * 50_000, "en", "s2"), (302, "ab cd " * 3000, "en", "s2")]
    rows += [(400 + i, f"{prose(rng, 15)} {base[7]} {prose(rng, 15)}", "de", "s1") for i in range(4)]
    return rows + [(5, base[5], "en", "s2"), (5, base[5], "en", "s2"), (None, base[6], "en", "s0")]


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = queries.tokenizer_path()
    return pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(model):
    v, sp = model
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r", "é", "漢", "🙂", "the", "ing", "{", "\x00", "aaaa", " " * 17, "▁", "<s>", "<0x0A>", "\u200b"]
    texts = ["", " ", "a" * 300, " " * 70, " " * 33 + "x"] + ["".join(rng.choices(parts, k=rng.randrange(1, 50))) for _ in range(1500)]
    ids, starts = pieces.Encoder(v).encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [sp.encode(t, add_eos=True) for t in texts]
    assert pieces.Decoder(v).decode(ids, starts) == [sp.decode(g) for g in got]


def test_decoding_of_any_ids(model):
    v, sp = model
    rng = random.Random(2)
    lists = [[rng.randrange(400) if rng.random() < 0.6 else rng.randrange(v.size) for _ in range(rng.randrange(12))] for _ in range(1500)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.array(sum(lists, []), np.int32)
    assert pieces.Decoder(v).decode(flat, starts) == [sp.decode(x) for x in lists]


def test_pieces_of_odd_rows(spark, model, odd):
    v, sp = model
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest(table(spark, odd), v).collect())
    said = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, *_ in odd:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i if i is not None else -1, len(ids), said(" ".join(map(str, ids))), said(sp.decode(ids))))
    assert got == sorted((i or -1, *rest) for i, *rest in want)


# --- quality rules


def counted(text):
    words = WORDS.findall(text or "")
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, odd):
    texts = odd + [(500, "a b\n a b\n\nx | y\na b\n", "en", "s"), (501, "p q r s t u p q r s t " * 3, "xx", "s"), (502, "&" * 300, "en", "s")]
    got = rules.judge(table(spark, texts)).collect()
    want = {i: counted(t) for i, t, *_ in texts}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_distance(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 0], [1, 0]), ([1, 0], [0, 1]), ([0, 0], [1, 1])], "p array<long>, q array<long>")
    assert [r[0] for r in df.select(rules.distance(F.col("p"), F.col("q"))).collect()] == [0.0, 1.0, 0.0]


# --- near-duplicates and repeats


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_minhash(spark, odd):
    got = rows_of(minhash.classes(table(spark, odd)), "doc_id")
    sets = {i: shingles(t) for i, t, *_ in odd if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    assert {i: r.component_id for i, r in got.items() if i is not None} == {i: root(i) for i in sets}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (root(i) == i) for i, r in got.items() if i is not None)
    assert got[None].kept and got[None].component_id is None
    kept = minhash.without_copies(table(spark, odd))
    assert kept.columns == table(spark, odd).columns and kept.where("doc_id = 204").count() == 0 and kept.where("doc_id is null").count() == 1


def test_the_stage_drops_copies_between_80_and_85(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(55)]
    changed = [*words[:27], "new", *words[28:]]
    docs = table(spark, [(1, " ".join(words), "en", "s"), (2, " ".join(changed), "en", "s"), (3, "a b c d e f g", "en", "s")])
    a, b = shingles(" ".join(words)), shingles(" ".join(changed))
    assert 0.81 < len(a & b) / len(a | b) < 0.83
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert {r.component_id for r in minhash.classes(docs).collect()} == {1, 2, 3}


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 115, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(x[:100]), np.unique(x[15:])
        agree.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(agree) - 85 / 115) < 0.03


def test_links_that_only_a_chain_joins(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join(words[8 * i : 8 * i + 200]), "en", "s") for i in range(20)]
    assert {r.component_id for r in minhash.classes(table(spark, texts)).collect()} == {0}


def test_repeats(spark, odd):
    texts = [r for r in odd if r[0] is not None]
    got = rows_of(repeats.cut_repeats(table(spark, texts)), "doc_id")
    seen, want = {}, {}
    for i, t in sorted({(i, t) for i, t, *_ in texts}, key=lambda r: r[0]):
        words, gone = WORDS.findall(t or ""), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.setdefault(window, i)
        want[i] = (len(words), " ".join(w for k, w in enumerate(words) if k not in gone))
    assert {i: (r.n_words, r.kept) for i, r in got.items()} == want
    assert all(s.end - s.start >= 20 for r in got.values() for s in r.repeats)


# --- vectors


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 20))
    near = np.concatenate([base[:60] + 0.1 * rng.normal(size=(60, 20)), np.repeat(base[:2], 40, axis=0), base[3] + 0.05 * rng.normal(size=(80, 20))])
    data = [v.tolist() for v in np.concatenate([base, near])] + [[0.0] * 20, [float("nan")] * 20, None, [1.0, None], [], [1e300] * 20, [3.0]]
    rows = [(i, v, None) for i, v in enumerate(data)]
    got = rows_of(vectors.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string")), "vec_id")
    unit, good = vectors._unit(data, 32)
    close = (unit @ unit.T >= 0.9) & good[:, None] & good[None, :]
    np.fill_diagonal(close, False)
    assert [got[i].n_links for i in range(len(data))] == close.sum(1).tolist()
    for i in range(len(data)):
        reach, more = {i}, {i}
        while more:
            more = {int(j) for k in more for j in np.flatnonzero(close[k])} - reach
            reach |= more
        assert got[i].component_id == min(reach) and got[i].kept == (i == min(reach))


def test_vector_recall_near_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(2000, 64))
    noise -= (noise * x[:2000]).sum(1, keepdims=True) * x[:2000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    other = 0.92 * x[:2000] + np.sqrt(1 - 0.92**2) * noise
    model = vectors.fit_rows(x[:4096], 20_000 // vectors.LIST_LENGTH)
    a, b = model.nearest(x[:2000], vectors.PROBES), model.nearest(other, vectors.PROBES)
    assert ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= 0.9


# --- secrets, toxicity, mixing, chat, URLs


def test_secret_spans():
    gauge, rng = secrets.Gauge(b""), random.Random(1)
    key = base64.b64encode(rng.randbytes(30)).decode()
    text = f"token=token:zzzzzzzzzzzzzzzz AKIA{'Q7' * 7} Password: 'abc+/_.=-1234 api_key=short deadbeef{'0' * 8} secret key here {key} end"
    found = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.scan_text(text, gauge, 0.6)]
    assert found == [
        ("access", f"AKIA{'Q7' * 7}"),
        ("assign", "Password: 'abc+/_.=-1234"),
        ("hex", f"deadbeef{'0' * 8}"),
        ("novel", key),
    ]
    assert secrets.scan_text(None, gauge, 0.6) == [] and secrets.scan_text("secret " + "z" * 60, gauge, 0.6) == []


def test_secrets_far_from_their_word_and_partly_covered():
    gauge, rng = secrets.Gauge(b""), random.Random(3)
    key = lambda n: base64.b64encode(rng.randbytes(n)).decode().replace("=", "")
    body = [key(48) for _ in range(25)]
    header = '"private_key": "-----BEGIN RSA PRIVATE KEY-----\\n'
    before, behind, far = key(30), key(30), key(30)
    run = f"{key(15)}Q{'0123456789abcdef' * 2}Q{key(15)}"
    for text, want in (
        (header + "\n".join(body) + "\n-----END", body),
        (f"use {before} as the token", [before]),
        (f"token {'. ' * 40} {behind}", [behind]),
        (f"token {'. ' * 200} {far}", []),
        (f"my secret: is {run} now", [run]),
    ):
        found = [text[s:e] for s, k, e in secrets.scan_text(text, gauge, 0.6) if secrets.KINDS[k] == "novel"]
        assert [w for w in want if not any(w in f for f in found)] == [] and len(found) <= len(want) + text.count("BEGIN")


def test_redaction_of_a_key_around_a_hexadecimal_run(spark):
    rng = random.Random(5)
    key = f"{base64.b64encode(rng.randbytes(18)).decode()}Q{'09af3b7c' * 2}Q{base64.b64encode(rng.randbytes(18)).decode()}"
    docs = table(spark, [(1, f"the credential is {key} here", "en", "s")])
    assert secrets.redact(docs, secrets.Model(b"", 0.6)).first().text == "the credential is [secret] here"


def test_secret_digest_and_redaction(spark, odd):
    hexes = "f" * 20
    docs = table(spark, [*odd, (600, f"é password={hexes} x", "en", "s")])
    model = secrets.fit(docs)
    r = rows_of(secrets.digest(secrets.find(docs, model)), "doc_id")[600]
    assert (r.n_assign, r.n_hex, r.spans) == (1, 1, "assign:2:31,hex:11:31")
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    cleaned = rows_of(secrets.redact(docs, model), "doc_id")
    assert cleaned[600].text == "é [secret] x" and cleaned[600].n_chars == 12 and cleaned[200].text is None


def test_the_novelty_threshold_comes_from_all_ordinary_strings(spark):
    rng = random.Random(8)
    odd_ones = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=32)) for _ in range(3)]
    text = " ".join(odd_ones + ["configuration_settings"] * 5000)
    docs = table(spark, [(1, text, "en", "s"), (2, f"{odd_ones[0]} secret", "en", "s"), (3, None, "en", "s")])
    model = secrets.fit(docs)
    assert model.novelty == secrets.LEAST_NOVELTY
    assert sum(r.n for r in secrets.novelties(docs, model.dictionary).collect()) == 5003
    assert model == secrets.fit(docs.repartition(5))
    assert secrets.threshold([(100, 9000), (850, 20)]) == 0.851 and secrets.threshold([]) == secrets.LEAST_NOVELTY


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["grumfoul", "zaskwit", "plorvex"]
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randrange(20, 90)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None), (901, "", "en", "s"), (None, "la ka", "en", "s"), (902, "x" * 30_000, "en", "s")]
    docs = table(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.classify(docs, marks), "doc_id")
    out = [i for i in range(400) if got[i].held_out]
    assert out and all(got[i].predicted == int(i % 4 == 0) for i in out)
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0 and 0 <= got[901].score < 0.1
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 304
    assert toxicity.classify(docs, marks.where("toxic = 0")).where("predicted = 1").count() == 0


def test_mixing(spark):
    rows = [(i, "t" * 10, "en", "big" if i < 3000 else "small") for i in range(4000)] + [(9000, None, None, None), (None, "abc", None, None)]
    docs = table(spark, rows)
    out = mixing.mix(docs, weights={"big": 1, "small": 1}, seed="a")
    assert out.columns == [*docs.columns, "copy_"]
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    same = lambda df: sorted((r.doc_id, r.copy_) for r in df.where("doc_id is not null").collect())
    assert same(out) == same(mixing.mix(docs.repartition(7), weights={"big": 1, "small": 1}, seed="a"))


def test_default_rates_may_be_large_and_explicit_ones_may_not(spark):
    docs = table(spark, [(1, "x", "en", None), (2, "ab cd " * 20_000, "en", "big")])
    rate = {r.source: r.rate for r in mixing.rates(docs, exponent=0.3).select("source", "rate").collect()}
    n = {r.source: r["count"] for r in mixing.mix(docs, exponent=0.3).groupBy("source").count().collect()}
    assert rate[None] > 2 * mixing.MAX_RATE and abs(n[None] - rate[None]) < 6 * rate[None] ** 0.5
    with pytest.raises(Exception, match="repeated more than 1000 times"):
        mixing.rates(table(spark, [(1, "x", "en", "a"), (2, "y" * 10_000, "en", "b")]), weights={"a": 1}).collect()


def test_poisson_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (0.4,), (30.0,), (900.0,)], "rate double")
    for r in df.select("rate", mixing.poisson_table(F.col("rate")).alias("t")).collect():
        mean = sum(1 - x for x in r.t) if r.rate else 0.0
        assert abs(mean - r.rate) < 1e-6 * max(1, r.rate)


def test_urls(spark):
    urls = ["HTTP://Sub.Example.NET:80?x", "https://a.example.net/en/1", "http://b.net/x", "no scheme", None, "", "x://Org/fr/2#q", "http://xexample.com/de/1", "http://example.com/de"]
    got = rows_of(urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert (got[0].host, got[0].path, got[0].rule) == ("sub.example.net:80", "", None)
    assert [got[i].rule for i in range(1, 9)] == ["example.net/en/", "net/", None, None, None, "org/fr/", None, None]
    assert (got[4].host, got[4].path, got[4].verdict) == ("", "", "allow")


def test_templates_learn_from_rules(spark):
    bad = [(i, f"http://h.org/ads/{i}.html") for i in range(300)]
    good = [(1000 + i, f"http://h.org/news/{i}.html") for i in range(300)]
    mixed = [(2000 + i, f"http://h.org/ads/{i}-{i}.html") for i in range(20)] + [(3000, "http://h.org/news/zzz"), (3001, "http://other.org/a/1")]
    judged = urltree.judge(
        spark.createDataFrame(bad + good + mixed, "page_id long, url string"),
        rules=[("h.org", f"/ads/{d}", "block") for d in range(1, 9)] + [("h.org", "/news/", "allow")],
    )
    got = rows_of(judged, "page_id")
    unruled = [i for i, _ in bad if got[i].rule is None]
    assert unruled and all(got[i].verdict == "block" for i in unruled)
    assert got[1005].verdict == got[3001].verdict == "allow"


def test_deep_paths_keep_all_segments(spark):
    bad = [(i, f"http://h.org/a/b/c/d/bad/{i}.html") for i in range(300)] + [(500 + i, f"http://h.org/a/b/c/d/e/f/g/h/i/j/bad/{i}.html") for i in range(300)]
    good = [(1000 + i, f"http://h.org/a/b/c/d/good/{i}.html") for i in range(300)] + [(1500 + i, f"http://h.org/a/b/c/d/e/f/g/h/i/j/good/{i}.html") for i in range(300)]
    alone = [(2000, "http://h.org/a/b/c/d/k/l/m/n/o"), (2001, "http://z.org/" + "/".join(map(chr, range(97, 109))))]
    tops = ("/a/b/c/d/", "/a/b/c/d/e/f/g/h/i/j/")
    rules = [("h.org", f"{t}bad/{d}", "block") for t in tops for d in range(1, 9)] + [("h.org", f"{t}good/{d}", "allow") for t in tops for d in range(1, 9)]
    got = rows_of(urltree.judge(spark.createDataFrame(bad + good + alone, "page_id long, url string"), rules=rules), "page_id")
    unruled = [i for i in got if got[i].rule is None]
    assert len(unruled) > 40
    assert {i for i in unruled if got[i].verdict == "block"} == {i for i in unruled if i < 1000}


# --- empty tables


def test_empty_tables(spark, model):
    docs = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        mixing.mix(docs),
        toxicity.classify(docs, labels),
        repeats.digest(repeats.cut_repeats(docs)),
        chat.digest(chat.perspectives(turns)),
        pieces.digest(docs, model[0]),
        vectors.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        secrets.digest(secrets.find(docs, secrets.fit(docs))),
        urltree.judge(spark.createDataFrame([], "page_id long, url string")),
        minhash.classes(docs),
        rules.judge(docs),
    ):
        assert df.count() == 0


# --- names and lengths


def test_mixing_keeps_columns_named_like_its_own(spark):
    schema = "doc_id long, text string, source string, Copy string, __at string, __N int, __table string, __source string, __order int"
    docs = spark.createDataFrame([(i, "t" * (i + 1), f"s{i % 2}", "c", "a", 1, "t", "s", 2) for i in range(40)], schema)
    made = mixing.mix(docs, {"s0": 1.0, "s1": 3.0})
    assert made.columns == [*docs.columns, "copy_"]
    rows = made.collect()
    assert rows and {tuple(r[3:9]) for r in rows} == {("c", "a", 1, "t", "s", 2)}
    assert {(r.doc_id, r["copy_"]) for r in rows} == {(r.doc_id, r["copy_"]) for r in mixing.mix(docs.select("doc_id", "text", "source"), {"s0": 1.0, "s1": 3.0}).withColumnRenamed("copy", "copy_").collect()}


def test_common_words_of_any_length(spark, tmp_path):
    long_word, rng = "w" * 70, random.Random(3)
    texts = [" ".join(rng.choice([long_word, "aa", "bb", f"r{rng.randrange(10**6)}", f"r{rng.randrange(10**6)}"]) for _ in range(50)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy") for i, t in enumerate(texts)] + [(100, "short words only", "zz")], "doc_id long, text string, lang string")
    from leadloom.llm.shared import Staged

    found = {r.lang: r.vocabulary for r in rules.common_words(docs, Staged(spark, "rules")).collect()}
    assert long_word in found["xx"] and long_word in found["yy"] and "aa" in found["xx"]
    assert found["zz"] == ["only", "short", "words"]
    assert not any(w.startswith(" ") for v in found.values() for w in v)


def test_the_verdict_of_the_rules_by_brute_force(spark):
    """Distances and verdict from plain counts of characters and words."""
    rng = random.Random(12)
    common = ["the", "of", "and", "in", "was"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) for _ in range(rng.randrange(20, 150))) for _ in range(60)]
    texts += ["QX7 " * 3 + " ".join(f"{rng.randrange(10**9)}" for _ in range(80)), " ".join(f"zz{rng.randrange(10**9)}" for _ in range(90)), "tiny text"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900, None, "en"), (901, "other " * 20, "xx")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def classes(t):
        kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\x0b\x0c\r", "0123456789", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
        counts = [sum(c in k for c in t) for k in kinds]
        return [*counts, len(t) - sum(counts)]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        part = lambda x, y: sum(a * np.log2(2 * a / (a + b)) for a, b in zip(x, y, strict=True) if a > 0)
        return float(np.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2)))

    english = [(i, t or "") for i, t, lang in rows if lang == "en"]
    all_classes = np.sum([classes(t) for _, t in english], axis=0)
    counted = collections.Counter(w for _, t in english for w in t.lower().split())
    total = sum(counted.values())
    vocabulary = sorted(w for w, n in counted.items() if n >= rules.COMMON_SHARE * total)
    all_words = [*(counted[w] for w in vocabulary), total - sum(counted[w] for w in vocabulary)]
    strange = 0
    for i, t in english:
        words = t.lower().split()
        mine = [words.count(w) for w in vocabulary]
        by_class, by_word = distance(classes(t), all_classes), distance([*mine, len(words) - sum(mine)], all_words)
        assert abs(got[i].class_distance - by_class) < 1e-9 and abs(got[i].word_distance - by_word) < 1e-9
        far = (len(t) >= rules.MIN_CHARS and by_class > rules.MAX_CLASS_DISTANCE) or (len(words) >= rules.MIN_WORDS and by_word > rules.MAX_WORD_DISTANCE)
        assert got[i].kept == (not got[i].base_failed and not far)
        strange += far
    assert strange >= 2 and total >= rules.MIN_REFERENCE_WORDS
    assert got[901].kept == (not got[901].base_failed)  # too few words for a reference


def test_centres_in_blocks_of_rows(monkeypatch):
    x = np.random.default_rng(5).normal(size=(700, 32))
    whole = vectors.fit_rows(x, 20)
    monkeypatch.setattr(vectors, "FIT_ROWS", 64)
    blocks = vectors.fit_rows(x, 20)
    assert np.allclose(whole.centres, blocks.centres) and np.array_equal(whole.nearest(x, 3), blocks.nearest(x, 3))


def test_leftmost_least_of_each_span():
    rng = np.random.default_rng(2)
    for span in (1, 2, 5, 15):
        values = rng.integers(0, 9, 400).astype(np.uint64)
        want = np.lib.stride_tricks.sliding_window_view(values, span).argmin(axis=1)
        assert np.array_equal(repeats.leftmost_least(values, span), want)


def test_only_texts_that_share_a_bucket_are_moved(spark, monkeypatch):
    rng = random.Random(31)
    texts = [prose(rng, 60) for _ in range(300)]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate([*texts, texts[7] + " end"])])
    packed, pack = [], minhash.pack
    monkeypatch.setattr(minhash, "pack", lambda df: packed.append({r.doc_id for r in df.collect()}) or pack(df))
    linked = {r.doc_id: r.component_id for r in minhash.classes(docs).collect()}
    assert linked[300] == linked[7] == 7 and sum(i != c for i, c in linked.items()) == 1
    assert len(packed) == 1 and {7, 300} <= packed[0] and len(packed[0]) < 30
