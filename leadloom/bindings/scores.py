"""Offer join, scoring, validation and classification over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.bindings.tables import table
from leadloom.functions.text import scorer_input as build_input
from leadloom.operators import scoring as M
from leadloom.session import work_folder
from leadloom.sources.pages import offer_join as join_offers
from leadloom.sources.pages import read_offers

c = F.col
THRESHOLD = 0.78


def profile(spark, d):
    """The profile document: the first benchmark item."""
    return table(spark, d, "benchmark").where(c("item_id") == 0).select(c("text").alias("profile"))


def _offers(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", c("text").alias("offer_markdown"), F.lit(None).cast("string").alias("error")
    )


def offer_join(spark, d):
    """Every document is a listing; its label is the offer text, if one was landed."""
    listings = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("https://offers.example.com/"), c("doc_id")).alias("url")
    )
    labels = table(spark, d, "labels")
    landed = labels.select(
        F.concat(F.lit("http://offers.example.com/"), c("doc_id")).alias("url"),
        F.when(c("toxic") == 0, F.concat(F.lit("quality "), c("quality"))).alias("offer_markdown"),
        F.when(c("toxic") == 1, F.lit("offer request failed with 451")).alias("error"),
        F.lit(1).alias("landed_no"),
    )
    again = labels.where(c("quality") == 1).select(
        F.concat(F.lit("https://offers.example.com/"), c("doc_id")).alias("url"),
        F.lit("quality 1, read again").alias("offer_markdown"),
        F.lit(None).cast("string").alias("error"),
        F.lit(2).alias("landed_no"),
    )
    return join_offers(listings, landed.unionByName(again), ["landed_no"])


def offer_relanded(spark, d):
    """Labels landed as offers on up to three days, read back; the last day of an address counts.

    Only documents that have a label are asked for.
    """
    labels = table(spark, d, "labels")

    def day(rows, at, text, error=None):
        return rows.select(
            F.concat(F.lit("http://offers.example.com/"), c("doc_id")).alias("url"),
            text.alias("offer_markdown"),
            (F.lit(None).cast("string") if error is None else error).alias("error"),
            F.lit(at).cast("string").alias("landed_at"),
        )

    folder = work_folder(spark, "offers")
    days = [
        day(labels, None, F.lit("zzz undated")),
        day(labels.where("quality = 1"), "2026-01-01", F.lit("yyy earlier")),
        day(labels.where("toxic = 1"), "2026-01-02", F.lit(None).cast("string"), F.lit("taken down")),
    ]
    for rows in days:
        rows.write.mode("append").partitionBy("landed_at").parquet(folder)
    asked = labels.select("doc_id", F.concat(F.lit("https://offers.example.com/"), c("doc_id")).alias("url"))
    return join_offers(asked, read_offers(spark, folder)).select("doc_id", "offer_markdown", "error")


def scorer_input(spark, d):
    text = build_input(profile(spark, d).scalar(), c("offer_markdown"))
    return _offers(spark, d).select("doc_id", text.alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest")
    )


def score_overlap(spark, d):
    scored = M.lexical_scorer(profile(spark, d))(_offers(spark, d))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "reason", "summary", "error")


def _cosines(spark, d):
    vectors = table(spark, d, "embeddings")
    mine = vectors.where(c("vec_id") == 0).select("embedding")
    return M.with_cosine(vectors, mine, "embedding", "cos")


def score_cosine(spark, d):
    return _cosines(spark, d).select("vec_id", (F.round("cos", 6) + 0.0).alias("score"))


def score_embedding(spark, d):
    """Vectors as offers: cosines clamped to 0..1, a reason, and an error for those without a direction."""
    vectors = table(spark, d, "embeddings")
    offers = vectors.select(
        "vec_id",
        F.when(c("label") == 3, F.transform("embedding", lambda x: x * 0)).otherwise(c("embedding")).alias("embedding"),
        F.when(c("label") == 5, F.lit("no vector landed")).alias("error"),
    )
    scored = M.embedding_scorer(vectors.where(c("vec_id") == 0).select("embedding"))(offers)
    return scored.select("vec_id", (F.round("score", 6) + 0.0).alias("score"), (F.length("reason") > 7).alias("reasoned"), "summary", "error")


def _by_length(spark, d):
    """A Python scorer that refuses short texts."""
    first = profile(spark, d).first()["profile"]

    def score_one(offer: str, profile_text: str) -> dict:
        if len(offer) < 1000:
            raise ValueError("offer is too short")
        n = len(offer)
        return {"score": n / (n + len(profile_text)), "reason": "by length", "summary": f"{n} characters"}

    return M.python_scorer(score_one, first)


def score_plugin(spark, d):
    scored = _by_length(spark, d)(_offers(spark, d))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "reason", "summary", "error")


def error_isolation(spark, d):
    """Outcome of each document: no text in the wrong language, then the failing scorer."""
    offers = table(spark, d, "documents").select(
        c("doc_id").alias("external_id"),
        F.when(c("lang") != "de", c("text")).alias("offer_markdown"),
        F.when(c("lang") == "de", F.lit("no reader for de")).alias("error"),
    )
    outcome = M.score_offers(offers, _by_length(spark, d), 0.9)
    return outcome.select(
        c("external_id").alias("doc_id"), F.round("match_score", 6).alias("match_score"), "summary", "status", "error", "fetched"
    )


def match_validate(spark, d):
    """Scores that may be missing, not a number, or out of range; some without a text."""
    v = c("value")
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(c("event_type") == "error", F.lit(float("nan"))).when(c("event_type") != "view", v / 50).alias("score"),
        F.when(c("event_type") == "click", F.lit("")).otherwise(c("event_type")).alias("reason"),
        c("props").alias("summary"),
        F.when(c("event_type") == "signup", F.lit("model timed out")).alias("error"),
    )
    return M.validated(raw).select("event_id", F.round("score", 6).alias("score"), "reason", "summary", "error")


def threshold_classify(spark, d):
    score = F.round((c("cos") + 1) / 2, 6)
    return _cosines(spark, d).select(
        "vec_id", (score + 0.0).alias("score"), M.verdict(score, 0.5).alias("status")
    )


def select_matches(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate",
        (c("l_discount") * 10).alias("score"), (c("l_returnflag") != "R").alias("should_save"),
    )
    picked = M.select_matches(rows, THRESHOLD)
    return picked.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best")
    )


QUERIES = {
    "offer_join": offer_join,
    "offer_relanded": offer_relanded,
    "scorer_input": scorer_input,
    "score_overlap": score_overlap,
    "score_cosine": score_cosine,
    "score_embedding": score_embedding,
    "score_plugin": score_plugin,
    "error_isolation": error_isolation,
    "match_validate": match_validate,
    "threshold_classify": threshold_classify,
    "select_matches": select_matches,
}

_MINE = "(SELECT text FROM benchmark WHERE item_id = 0)"
_COS = """(SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS cos
  FROM embeddings)"""
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
_N = f"(length(text) / (length(text) + length({_MINE})))"

ORACLE = {
    "offer_join": """
        SELECT doc_id, 'https://offers.example.com/' || doc_id AS url,
          CASE WHEN quality = 1 THEN 'quality 1, read again' WHEN toxic = 0 THEN 'quality ' || quality END AS offer_markdown,
          CASE WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'offer request failed with 451' WHEN quality IS NULL THEN 'no offer text' END AS error
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "offer_relanded": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'yyy earlier' ELSE 'zzz undated' END AS offer_markdown,
          CASE WHEN toxic = 1 THEN 'taken down' END AS error FROM labels""",
    "scorer_input": f"""
        SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id,
          'CV MARKDOWN:' || chr(10) || {_MINE} || chr(10) || chr(10) || 'JOB OFFER MARKDOWN:' || chr(10) || text AS t FROM documents)""",
    "score_overlap": f"""
        SELECT doc_id, round(share, 6) AS score,
          printf('%.0f%% of the profile''s words occur in the offer', share * 100) AS reason,
          len(theirs) || ' words in the offer' AS summary, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, len(list_intersect(mine, theirs)) / len(mine) AS share FROM (
          SELECT doc_id, {_WORDS.format('text')} AS theirs, (SELECT {_WORDS.format('text')} FROM benchmark WHERE item_id = 0) AS mine
          FROM documents))""",
    "score_embedding": f"""
        SELECT vec_id, CASE WHEN label <> 3 THEN round(greatest(0.0, least(1.0, cos)), 6) + 0.0 END AS score,
          CASE WHEN label = 3 THEN NULL ELSE true END AS reasoned, 'vector comparison' AS summary,
          CASE WHEN label = 5 THEN 'no vector landed' WHEN label = 3 THEN 'no direction' END AS error
        FROM embeddings JOIN {_COS} USING (vec_id)""",
    "score_cosine": f"SELECT vec_id, round(cos, 6) + 0.0 AS score FROM {_COS}",
    "score_plugin": f"""
        SELECT doc_id, CASE WHEN length(text) >= 1000 THEN round({_N}, 6) END AS score,
          CASE WHEN length(text) >= 1000 THEN 'by length' END AS reason,
          CASE WHEN length(text) >= 1000 THEN length(text) || ' characters' END AS summary,
          CASE WHEN length(text) < 1000 THEN 'offer is too short' END AS error FROM documents""",
    "error_isolation": f"""
        SELECT doc_id, CASE WHEN ok THEN round({_N}, 6) END AS match_score,
          CASE WHEN ok THEN length(text) || ' characters' END AS summary,
          CASE WHEN NOT ok THEN 'error' WHEN {_N} >= 0.9::DOUBLE THEN 'matched' ELSE 'rejected' END AS status,
          CASE WHEN lang = 'de' THEN 'no reader for de' WHEN NOT ok THEN 'offer is too short' END AS error,
          lang <> 'de' AS fetched
        FROM (SELECT *, lang <> 'de' AND length(text) >= 1000 AS ok FROM documents)""",
    "match_validate": """
        SELECT event_id, CASE WHEN error IS NULL THEN round(score, 6) END AS score,
          CASE WHEN error IS NULL THEN event_type END AS reason, CASE WHEN error IS NULL THEN props END AS summary, error
        FROM (SELECT *, value / 50 AS score, CASE event_type WHEN 'signup' THEN 'model timed out'
            WHEN 'error' THEN 'score is not a number' WHEN 'view' THEN 'score is not a number'
            ELSE CASE WHEN value / 50 < 0 OR value / 50 > 1 THEN 'score is outside 0..1'
              WHEN event_type = 'click' THEN 'reason is empty' END END AS error FROM events)""",
    "threshold_classify": f"""
        SELECT vec_id, score + 0.0 AS score, CASE WHEN score >= 0.5::DOUBLE THEN 'matched' ELSE 'rejected' END AS status
        FROM (SELECT vec_id, round((cos + 1) / 2, 6) AS score FROM {_COS})""",
    "select_matches": """
        SELECT l_orderkey, count(*)::BIGINT AS n, round(max(l_discount * 10::DOUBLE), 6) AS best FROM lineitem
        WHERE l_returnflag <> 'R' AND l_discount * 10::DOUBLE >= 0.78::DOUBLE GROUP BY l_orderkey""",
}
