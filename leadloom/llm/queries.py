"""The operators applied to whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.bindings.tables import table
from leadloom.llm import chat, minhash, mixing, pieces, quality, repair, repeats, rules, secrets, toxicity, urltree, vectors, whitening


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(repeats.cut_repeats(table(spark, folder, "documents")))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digest(chat.perspectives(table(spark, folder, "conversations")))


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(table(spark, folder, "documents"), pieces.load(tokenizer_path()))


def op6_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.classes(table(spark, folder, "embeddings"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.digest(secrets.find(docs, secrets.fit(docs)))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urltree.judge(table(spark, folder, "pages"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(table(spark, folder, "documents"), similar=85)


def op10_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents"))


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damaged(table(spark, folder, "conversations")), copies="copies"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.digest(table(spark, folder, "embeddings"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_repeats": op3_repeats,
    "op4_chat": op4_chat,
    "op5_pieces": op5_pieces,
    "op6_vectors": op6_vectors,
    "op7_secrets": op7_secrets,
    "op8_urls": op8_urls,
    "op9_minhash": op9_minhash,
    "op10_rules": op10_rules,
    "op11_repair": op11_repair,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

ORACLE = {"op1_mixing": mixing.ORACLE_SQL, "op3_repeats": repeats.ORACLE_SQL, "op4_chat": chat.ORACLE_SQL, "op11_repair": repair.ORACLE_SQL}
