"""Whole runs over stored rows, with stub scorers."""

import pytest

from leadloom.operators.scoring import python_scorer
from leadloom.operators.summary import as_json, run_summary
from leadloom.plans.run import process_listings
from leadloom.schemas import JOBS, OFFERS
from leadloom.session import work_folder
from leadloom.sources.state_table import StateTable

NOW = "2024-03-01T00:00:00.000Z"
LISTING = "external_id string, source string, url string, title string, company string, salary_text string, location string, page_no int, pos int"


def listing(name):
    return (f"s:/{name}", "justjoinit", f"https://h.example/{name}", f"Role {name}", f"Company {name}", None, "Remote", 1, 0)


def stored(name, status):
    return (f"s:/{name}", "justjoinit", f"https://h.example/{name}", f"Role {name}", f"Company {name}", None, "Remote",
            None, None, None, None, status, "2024-01-01", "2024-01-01")


def _scorer(scores):
    def score_one(offer, profile):
        value = scores[offer]
        if value is None:
            raise RuntimeError("score failed")
        return {"score": value, "reason": f"because {value}", "summary": f"about {value}"}

    return lambda profile: python_scorer(score_one, profile.first()["profile"])


def _run(spark, names, prior=(), scores=None, missing=(), load=None):
    table = StateTable(spark, work_folder(spark, "jobs"))
    if prior:
        table.append_changes(spark.createDataFrame(list(prior), JOBS))
    listings = spark.createDataFrame([listing(n) for n in names], LISTING)
    offers = spark.createDataFrame(
        [(f"http://h.example/{n}", None if n in missing else n, "refused" if n in missing else None, None) for n in names], OFFERS
    )
    load = load or (lambda: spark.createDataFrame([("cv",)], "profile string"))
    outcomes = process_listings(listings, table, offers, load, _scorer(scores or {}), 0.75, NOW)
    return table, tuple(run_summary(outcomes, table.read()).first()), {r["external_id"]: r for r in table.read().collect()}


# scanned, skipped, fetched, matched, rejected, failed, stored
def test_terminal_rows_are_skipped(spark):
    prior = [stored("a", "matched"), stored("b", "rejected")]
    _, summary, rows = _run(spark, ["a", "b", "c"], prior, {"c": 0.2})
    assert summary == (3, 2, 1, 0, 1, 0, 3)
    assert (rows["s:/a"]["updated_at"], rows["s:/c"]["status"], rows["s:/c"]["match_reason"]) == ("2024-01-01", "rejected", "because 0.2")


def test_profile_is_not_read_without_work(spark):
    def load():
        raise AssertionError("must not be read")

    _, summary, _ = _run(spark, ["a", "b"], [stored("a", "matched"), stored("b", "rejected")], load=load)
    assert summary == (2, 2, 0, 0, 0, 0, 2)


def test_unreadable_profile_fails_the_run_and_keeps_the_sightings(spark):
    table = StateTable(spark, work_folder(spark, "jobs"))
    listings = spark.createDataFrame([listing("a")], LISTING)

    def load():
        raise FileNotFoundError("cv.md")

    with pytest.raises(FileNotFoundError):
        process_listings(listings, table, spark.createDataFrame([], OFFERS), load, _scorer({}), 0.75, NOW)
    assert [r["status"] for r in table.read().collect()] == ["discovered"]


def test_error_and_stuck_rows_are_retried(spark):
    prior = [stored("a", "error"), stored("b", "scoring")]
    _, summary, rows = _run(spark, ["a", "b"], prior, {"a": 0.94, "b": 0.75})
    assert summary == (2, 0, 2, 2, 0, 0, 2)
    assert rows["s:/a"]["created_at"] == "2024-01-01" and rows["s:/a"]["updated_at"] == NOW


def test_failed_scores_stay_with_their_row(spark):
    _, summary, rows = _run(spark, ["a", "b"], scores={"a": None, "b": 0.88})
    assert summary == (2, 0, 2, 1, 0, 1, 2)
    assert (rows["s:/a"]["status"], rows["s:/a"]["offer_markdown"]) == ("error", "a")


def test_failed_fetches_stay_with_their_row(spark):
    _, summary, rows = _run(spark, ["a", "b"], scores={"b": 0.81}, missing=["a"])
    assert summary == (2, 0, 1, 1, 0, 1, 2)
    assert (rows["s:/a"]["status"], rows["s:/a"]["offer_markdown"]) == ("error", None)


def test_a_second_run_changes_nothing(spark):
    table, first, before = _run(spark, ["a", "b"], scores={"a": 0.9, "b": 0.1})
    listings = spark.createDataFrame([listing(n) for n in "ab"], LISTING)
    outcomes = process_listings(listings, table, spark.createDataFrame([], OFFERS), None, None, 0.75, "2099")
    summary = run_summary(outcomes, table.read())
    assert tuple(summary.first()) == (2, 2, 0, 0, 0, 0, 2)
    assert {r["external_id"]: r for r in table.read().collect()} == before
    assert as_json(summary).first()["json"].startswith('{"scanned":2,"skipped":2,')


def test_counters_move_during_a_run(spark):
    told = []
    table = StateTable(spark, work_folder(spark, "jobs"))
    table.append_changes(spark.createDataFrame([stored("a", "matched")], JOBS))
    listings = spark.createDataFrame([listing(n) for n in "abcd"], LISTING)
    offers = spark.createDataFrame([("http://h.example/b", "b", None, None), ("http://h.example/c", "c", None, None)], OFFERS)
    load = lambda: spark.createDataFrame([("cv",)], "profile string")
    process_listings(listings, table, offers, load, _scorer({"b": 0.9, "c": None}), 0.75, NOW, progress=lambda s, c: told.append((s, c)))
    names = ("discovered", "skipped", "queued_fetch", "queued_score", "matched", "rejected", "failed")
    assert [(s, tuple(c[n] for n in names)) for s, c in told] == [
        ("discovered", (4, 1, 3, 0, 0, 0, 0)),
        ("fetched", (4, 1, 0, 2, 0, 0, 1)),
        ("scored", (4, 1, 0, 0, 1, 0, 2)),
    ]
