"""Scoring offers against the profile document, and the verdict.

A scorer takes offers (key, ``offer_markdown``, ``error``) and returns the same
rows with ``score``, ``reason`` and ``summary`` added.  Scoring happens in
place, so the offer texts are neither shuffled nor read twice.  A failure is a
row with ``error`` set, never an exception: one bad offer cannot stop a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.permits import permit

Scorer = Callable[[DataFrame], DataFrame]


def words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def overlap(profile_words: Column, offer_words: Column) -> Column:
    """Share of the profile's words found in the offer."""
    return F.size(F.array_intersect(profile_words, offer_words)) / F.nullif(
        F.size(profile_words), F.lit(0)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, computed in double precision."""
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    pairs = F.zip_with(
        a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    )
    return F.aggregate(
        pairs,
        zero,
        lambda acc, p: F.struct(
            (acc["ab"] + p["x"] * p["y"]).alias("ab"),
            (acc["aa"] + p["x"] * p["x"]).alias("aa"),
            (acc["bb"] + p["y"] * p["y"]).alias("bb"),
        ),
        lambda acc: acc["ab"] / F.nullif(F.sqrt(acc["aa"]) * F.sqrt(acc["bb"]), F.lit(0.0)),
    )


def with_cosine(rows: DataFrame, one: DataFrame, vector: str, out: str) -> DataFrame:
    """Add the cosine of each row's vector to the single vector of ``one``.

    The single vector is a scalar subquery, so nothing is joined.
    """
    mine = one.select(vector).scalar()
    return (
        rows.withColumn("__mine", mine)
        .withColumn(out, cosine(F.col(vector), F.col("__mine")))
        .drop("__mine")
    )


def lexical_scorer(profile: DataFrame, text: str = "offer_markdown") -> Scorer:
    """Score by the share of the profile's words in the offer.

    The profile is one row; it enters the plan as a scalar subquery, so more
    than one row is an error and nothing is joined.
    """
    mine = profile.select(words(F.col("profile"))).scalar()

    def score(offers: DataFrame) -> DataFrame:
        share = F.col("__share")
        return (
            offers.withColumns({"__mine": mine, "__words": words(F.col(text))})
            .withColumn("__share", overlap(F.col("__mine"), F.col("__words")))
            .select(
                *[c for c in offers.columns if c != "error"],
                share.alias("score"),
                F.format_string("%.0f%% of the profile's words occur in the offer", share * 100).alias("reason"),
                F.format_string("%d words in the offer", F.size("__words")).alias("summary"),
                F.when(F.col("error").isNotNull(), F.col("error"))
                .when(share.isNull(), F.lit("nothing to compare"))
                .alias("error"),
            )
        )

    return score


def embedding_scorer(profile: DataFrame, vector: str = "embedding") -> Scorer:
    """Score by cosine to the profile's vector, clamped to 0..1."""

    def score(offers: DataFrame) -> DataFrame:
        cos = F.col("__cos")
        return with_cosine(offers, profile, vector, "__cos").select(
            *[c for c in offers.columns if c != "error"],
            F.when(cos.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos))).alias("score"),
            F.when(cos.isNotNull(), F.format_string("cosine %.4f", cos)).alias("reason"),
            F.lit("vector comparison").alias("summary"),
            F.when(F.col("error").isNotNull(), F.col("error"))
            .when(cos.isNull(), F.lit("no direction"))
            .alias("error"),
        )

    return score


def python_scorer(
    score_one: Callable[[str, str], dict],
    profile: str,
    text: str = "offer_markdown",
    parallelism: int | None = None,
) -> Scorer:
    """Score with a Python callable ``(offer, profile) -> {score, reason, summary}``.

    Rows pass through Python in Arrow batches; those with an error already are
    left alone.  ``parallelism`` bounds the calls an executor makes at the same time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, reasons, summaries, errors = [], [], [], []
            for offer, error in zip(batch[text], batch["error"]):
                score, reason, summary = None, None, None
                if error is None:
                    try:
                        with permit("score", parallelism):
                            m = score_one(offer, profile)
                        score, reason, summary = float(m["score"]), m["reason"], m["summary"]
                    except Exception as problem:  # one bad row must not stop the others
                        error = str(problem) or type(problem).__name__
                scores.append(score)
                reasons.append(reason)
                summaries.append(summary)
                errors.append(error)
            yield batch.assign(
                score=pd.Series(scores, dtype="float64", index=batch.index),
                reason=reasons,
                summary=summaries,
                error=errors,
            )

    def score(offers: DataFrame) -> DataFrame:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in offers.schema]
        return offers.mapInPandas(run, ", ".join([*fields, "score double", "reason string", "summary string"]))

    return score


def validated(matches: DataFrame) -> DataFrame:
    """Reject scores outside 0..1 (NaN included) and empty reasons or summaries.

    A rejected row keeps its key and carries the problem in ``error``.
    """
    score = F.col("score")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(score.isNull() | F.isnan(score), F.lit("score is not a number"))
        .when((score < 0) | (score > 1), F.lit("score is outside 0..1"))
        .when(F.coalesce(F.length("reason"), F.lit(0)) == 0, F.lit("reason is empty"))
        .when(F.coalesce(F.length("summary"), F.lit(0)) == 0, F.lit("summary is empty"))
    )
    good = F.col("error").isNull()
    return matches.withColumn("error", problem).withColumns(
        {c: F.when(good, F.col(c)) for c in ("score", "reason", "summary")}
    )


def passes(score: Column, threshold: float) -> Column:
    """Threshold test, inclusive; NaN and NULL fail."""
    s = score.cast("double")
    return F.coalesce((s >= F.lit(float(threshold))) & ~F.isnan(s), F.lit(False))


def verdict(score: Column, threshold: float) -> Column:
    return F.when(passes(score, threshold), F.lit("matched")).otherwise(F.lit("rejected"))


def select_matches(candidates: DataFrame, threshold: float, score: str = "score", flag: str = "should_save") -> DataFrame:
    return candidates.where(F.col(flag) & passes(F.col(score), threshold))


def score_offers(offers: DataFrame, scorer: Scorer, threshold: float, key: str = "external_id") -> DataFrame:
    """Outcome of every offer row: fetch failed, scoring failed, matched or rejected.

    ``offers`` are listings with ``offer_markdown`` or ``error``; the result
    holds what is written back to the state.
    """
    checked = validated(scorer(offers.select(key, "offer_markdown", "error")))
    failed = F.col("error").isNotNull()
    return checked.select(
        key,
        "offer_markdown",
        F.col("score").alias("match_score"),
        F.col("reason").alias("match_reason"),
        "summary",
        F.when(failed, F.lit("error")).otherwise(verdict(F.col("score"), threshold)).alias("status"),
        "error",
        F.col("offer_markdown").isNotNull().alias("fetched"),
    )
