"""A corpus from raw documents to token ids: five stages, each on what the one before it kept.

1. ``toxicity`` drops documents whose score says toxic.
2. ``near_duplicates`` keeps one document of each group of near-copies.
3. ``secrets`` replaces found secrets in the texts.
4. ``mixing`` replicates the sources' documents to their target shares.
5. ``pieces`` encodes the texts and decodes them again.

Null and empty texts are neither toxic nor secret nor copies of anything, so they
reach the mixing like others and have an end id only.  Documents without an id stay
in every stage.  Of rows that share an id, the near-duplicates drop all or none.
Further columns stay to the mixing, whatever their names; the pieces leave them out.
Without labels nothing is toxic; an empty table gives an empty table.

The models of toxicity and secrets are trained, and the scans are regular
expressions and compressors, so no SQL can give the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.bindings.tables import table
from leadloom.llm import minhash, mixing, queries, secrets, toxicity
from leadloom.llm import pieces as sentence_pieces
from leadloom.session import stage


def calm(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` and ``n_tokens`` of each copy."""
    vocabulary = sentence_pieces.load(queries.tokenizer_path())
    encoded = sentence_pieces.decode(sentence_pieces.encode(docs, vocabulary), vocabulary)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", calm),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("pieces", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
