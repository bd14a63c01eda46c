import math

import pytest
from pyspark.sql import functions as F

from leadloom.operators import scoring as M
from leadloom.sources.pages import offer_join, read_offers, read_profile

OFFERS = "external_id string, offer_markdown string, error string"


def _profile(spark, text="Rust rust, Łódź 2"):
    return spark.createDataFrame([(text,)], "profile string")


def _offers(spark, *rows):
    return spark.createDataFrame(list(rows), OFFERS)


def _rows(df):
    return {r["external_id"]: r for r in df.collect()}


def test_lexical_scorer(spark):
    offers = _offers(spark, ("a", "RUST in łódź!", None), ("b", "go", None), ("c", None, "no text"))
    rows = _rows(M.lexical_scorer(_profile(spark))(offers))
    assert rows["a"]["score"] == pytest.approx(2 / 3) and rows["b"]["score"] == 0.0
    assert rows["c"]["error"] == "no text"
    plan = M.lexical_scorer(_profile(spark))(offers)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_more_than_one_profile_is_an_error(spark):
    two = _profile(spark).union(_profile(spark))
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        M.lexical_scorer(two)(_offers(spark, ("a", "x", None))).collect()


def test_embedding_scorer_clamps(spark):
    rows = spark.createDataFrame(
        [("same", [2.0, 0.0], None), ("back", [-1.0, 0.0], None), ("side", [0.0, 3.0], None), ("none", [0.0, 0.0], None)],
        "external_id string, embedding array<float>, error string",
    )
    one = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    got = _rows(M.validated(M.embedding_scorer(one)(rows)))
    assert (got["same"]["score"], got["back"]["score"], got["side"]["score"]) == (1.0, 0.0, 0.0)
    assert got["none"]["error"] == "no direction"


def test_python_scorer_isolates_rows(spark):
    def score_one(offer, profile):
        if offer == "bad":
            raise RuntimeError("model timed out")
        return {"score": 0.5, "reason": profile, "summary": offer}

    offers = _offers(spark, ("a", "x", None), ("b", "bad", None), ("c", None, "403"), ("d", "y", None))
    rows = _rows(M.python_scorer(score_one, "cv", parallelism=2)(offers))
    assert {k: (r["score"], r["error"]) for k, r in rows.items()} == {
        "a": (0.5, None), "b": (None, "model timed out"), "c": (None, "403"), "d": (0.5, None),
    }
    assert rows["a"]["offer_markdown"] == "x"


def test_validation(spark):
    schema = "external_id string, score double, reason string, summary string, error string"
    raw = [
        ("ok", 1.0, "r", "s", None), ("zero", 0.0, "r", "s", None), ("nan", math.nan, "r", "s", None), ("high", 1.01, "r", "s", None),
        ("low", -0.1, "r", "s", None), ("null", None, "r", "s", None), ("reason", 0.5, "", "s", None), ("summary", 0.5, "r", None, None),
    ]
    rows = _rows(M.validated(spark.createDataFrame(raw, schema)))
    assert {k for k, r in rows.items() if r["error"] is None} == {"ok", "zero"}
    assert rows["high"]["score"] is None


def test_threshold_is_inclusive_and_in_double(spark):
    df = spark.createDataFrame([(0.78,), (0.7799999,), (math.nan,), (None,), (1.0,)], "s double")
    got = [r[0] for r in df.select(M.verdict(F.col("s"), 0.78)).collect()]
    assert got == ["matched", "rejected", "rejected", "rejected", "matched"]


def test_select_matches_needs_the_flag_too(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.9, False), (3, 0.1, True), (4, 0.8, True)], "i int, score double, should_save boolean")
    assert [r["i"] for r in M.select_matches(df, 0.8).collect()] == [1, 4]


def test_outcomes(spark):
    offers = _offers(spark, ("a", "rust łódź 2", None), ("b", "", None), ("c", None, "timeout"))
    rows = _rows(M.score_offers(offers, M.lexical_scorer(_profile(spark)), 0.75))
    assert {k: (r["status"], r["fetched"], r["error"]) for k, r in rows.items()} == {
        "a": ("matched", True, None), "b": ("rejected", True, None), "c": ("error", False, "timeout"),
    }


def test_offer_join_by_address_without_scheme(spark):
    listings = spark.createDataFrame([("a", "https://h/1"), ("b", "https://h/2"), ("c", "https://h/3"), ("d", "https://h/4")], "external_id string, url string")
    offers = spark.createDataFrame(
        [("http://h/1", "old", None, 1), ("https://h/1", "new", None, 2), ("https://h/2", None, "403", 1), ("h/4", "", None, 1)],
        "url string, offer_markdown string, error string, n int",
    )
    rows = _rows(offer_join(listings, offers, ["n"]))
    assert {k: (r["offer_markdown"], r["error"]) for k, r in rows.items()} == {
        "a": ("new", None), "b": (None, "403"), "c": (None, "no offer text"), "d": ("", None),
    }


def test_profile_is_one_whole_document(spark, tmp_path):
    path = tmp_path / "cv.md"
    path.write_text("# Me\n\n- one\n")
    assert [r["profile"] for r in read_profile(spark, str(path)).collect()] == ["# Me\n\n- one\n"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_profile(spark, str(tmp_path / "none.md"))


def test_only_texts_asked_for_move(spark, tmp_path):
    """Ten open rows over many landings of many offers: ten texts are shuffled."""
    offers = spark.range(0, 20_000, 1, 8).select(
        F.concat(F.lit("http://h/"), F.col("id") % 4000).alias("url"),
        F.concat(F.lit("text "), F.col("id"), F.lit(" "), F.repeat(F.lit("x"), F.lit(200))).alias("offer_markdown"),
        F.lit(None).cast("string").alias("error"),
        F.concat(F.lit("2026-01-0"), F.floor(F.col("id") / 4000) + 1).alias("landed_at"),
    )
    offers.write.partitionBy("landed_at").parquet(str(tmp_path / "offers"))
    listings = spark.range(10).select(F.col("id").cast("string").alias("external_id"), F.concat(F.lit("https://h/"), F.col("id") * 7).alias("url"))
    made = offer_join(listings, read_offers(spark, str(tmp_path / "offers")))
    texts = {r["external_id"]: r["offer_markdown"].split()[1] for r in made.collect()}
    assert texts == {str(i): str(16_000 + 7 * i) for i in range(10)}
    # what reaches the exchanges: the rows the filters let through
    seen = []

    def below_exchange(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return below_exchange(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return below_exchange(plan.plan())
        if plan.nodeName() == "Exchange":
            seen.append(plan.metrics().apply("shuffleRecordsWritten").value())
        for i in range(plan.children().size()):
            below_exchange(plan.children().apply(i))

    execution = made._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    below_exchange(execution.executedPlan())
    # a key filter may let one in 64 of the newest landing through besides
    assert seen and 10 <= max(seen) <= 10 + 4000 // 64


def test_the_last_landing_of_an_offer_counts(spark):
    listings = spark.createDataFrame([("a", "https://h/1")], "external_id string, url string")

    def text(*landed):
        offers = spark.createDataFrame([("http://h/1", t, e, at) for t, e, at in landed], "url string, offer_markdown string, error string, landed_at string")
        row = offer_join(listings, offers).first()
        return row["offer_markdown"], row["error"]

    assert text(("zzz old", None, "2026-01-01"), ("aaa new", None, "2026-01-02")) == ("aaa new", None)
    assert text(("aaa new", None, "2026-01-02"), ("zzz", None, None)) == ("aaa new", None)
    assert text(("zzz", None, None)) == ("zzz", None)
    assert text(("zzz old", None, "2026-01-01"), (None, "gone", "2026-01-02")) == (None, "gone")
    assert text(("b", None, "2026"), ("a", None, "2026")) == ("b", None)


def test_calls_are_bounded_over_many_partitions(spark, tmp_path):
    """At most two calls at a time with 64 partitions on 8 cores."""

    def score_one(offer, profile):
        mine = tmp_path / offer
        mine.write_text("")
        now = len(list(tmp_path.iterdir()))
        import time

        time.sleep(0.02)
        mine.unlink()
        return {"score": 0.5, "reason": str(now), "summary": "s"}

    offers = spark.range(64).select(
        F.col("id").cast("string").alias("external_id"), F.col("id").cast("string").alias("offer_markdown"), F.lit(None).cast("string").alias("error")
    ).repartition(64)
    scored = M.python_scorer(score_one, "cv", parallelism=2)(offers)
    assert "Exchange" not in scored._jdf.queryExecution().sparkPlan().toString().replace("Exchange RoundRobin", "", 1)
    assert max(int(r["reason"]) for r in scored.collect()) <= 2
