"""The whole pipeline on odd and on empty tables, and its stages' effect on what they get."""

import random

import pytest

import corpus_pipeline
from leadloom.llm import minhash, mixing, queries, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Copy string, __at int, score string, component_id int"
LABELS = "doc_id long, quality int, toxic int, text string, extra int"


def prose(rng, n):
    return " ".join(rng.choice(["la", "ve", "on", "ti", "er"]) + rng.choice(["ka", "mo", "ru", "shen", "dor"]) + rng.choice(["", "s", "li", "nat"]) for _ in range(n))


def folder(spark, path, docs, labels):
    spark.createDataFrame([(*d, len(d[1] or ""), "c", 1, "s", 2) for d in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, "t", 1) for x in labels], LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(30, 90)) for _ in range(300)]
    toxic = [int(rng.random() < 0.3) for _ in texts]
    texts = [f"{t[:40]} slime {t[40:]}" if y else t for t, y in zip(texts, toxic, strict=True)]
    docs = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    near = max((t.split() for t, y in zip(texts, toxic, strict=True) if not y), key=len)
    docs += [(1000 + i, texts[5], "en", "s1") for i in range(20)] + [(2000, " ".join([*near[:9], "other", *near[10:]]), "en", "s0")]
    docs += [(3000, None, None, None), (3001, "", "en", "s1"), (3002, " \n", None, "s2"), (None, prose(rng, 40), "en", "s0"), (None, None, None, None)]
    docs += [(3003, "y" * 60_000, "en", None), (3004, f"{prose(rng, 40)} api_key = 'q8Zk3vT0xWbN5rLm2pYc7dHs'", "de", "s2"), (7, texts[7], "en", "s1")]
    labels = [(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (3001, None, None), (4, 1, toxic[4])]
    return docs, labels, folder(spark, tmp_path_factory.mktemp("odd"), docs, labels)


def test_stages_on_odd_tables(spark, tables):
    docs, labels, path = tables
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "pieces"]
    made, now = {}, spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    for name, apply in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(apply(spark, now, path), f"test-{name}")
        made[name] = now
        if name != "pieces":
            assert now.columns == columns
    said = lambda name: [r.text for r in made[name].select("text").collect()]
    calm, single, clean = said("toxicity"), said("near_duplicates"), said("secrets")
    assert not any("slime" in (t or "") for t in calm)
    assert sum("slime" not in (d[1] or "") for d in docs) - len(calm) <= 6  # clean ones stay
    # exact and near copies leave one; nulls, empty texts and documents without id stay
    assert single.count(None) == 2 and "" in single and " \n" in single
    kept = {r.doc_id for r in made["near_duplicates"].collect()}
    assert kept.isdisjoint({*range(1001, 1020), 2000})
    assert len(clean) == len(single) and not any("q8Zk3vT0xWbN5rLm2pYc7dHs" in (t or "") for t in clean)
    assert any("[secret]" in (t or "") for t in clean)
    copies = made["mixing"].groupBy("doc_id").count().count()
    assert 0 < copies <= len(clean)
    pieces = made["pieces"].collect()
    assert len(pieces) == made["mixing"].count() and set(made["pieces"].columns) >= {"doc_id", "ids", "decoded", "n_tokens"}
    assert all(len(r.ids) == r.n_tokens >= 1 for r in pieces)


def test_run_equals_its_stages(spark, tables):
    _, _, path = tables
    ids = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    calm = corpus_pipeline.stage(toxicity.without_toxic(docs, spark.read.parquet(f"{path}/labels.parquet")), "test")
    single = corpus_pipeline.stage(minhash.without_copies(calm), "test")
    clean = corpus_pipeline.stage(secrets.redact(single, secrets.fit(single)), "test")
    mixed = mixing.mix(clean).select("doc_id", "text")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(sp.encode(r.text or "")) + 1) for r in mixed.collect())
    assert ids == want


def test_empty_tables(spark, tmp_path):
    made = corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [], []))
    assert made.count() == 0 and {"doc_id", "ids", "decoded", "n_tokens"} <= set(made.columns)
    docs = [(i, f"some text number {i} of a few", "en", "s") for i in range(5)]
    made = corpus_pipeline.run(spark, folder(spark, tmp_path / "unlabelled", docs, []))
    assert {r.doc_id for r in made.collect()} <= set(range(5))
