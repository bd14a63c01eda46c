from pyspark.sql import functions as F

from leadloom.functions import lines
from leadloom.functions import text as T


def test_clean_text_knows_every_blank(values):
    assert values(T.clean_text, " a\u00a0\ufeff b\n", "\u2003", "", None, "x") == ["a b", None, None, None, "x"]


def test_slugify(values):
    assert values(T.slugify, "  Gdańsk  Nowy\tPort ", "C#") == ["gdańsk-nowy-port", "c#"]


def test_places_and_titles(values):
    assert values(lambda v: T.strip_more_places(T.clean_text(v)), "Poznań  +3 more", "+2", None, "A +b") == ["Poznań", "", None, "A +b"]
    assert values(lambda v: T.strip_new_mark(T.clean_text(v)), "Dev  NOWA ", "NOWA", "Dev NOWA x") == ["Dev", "NOWA", "Dev NOWA x"]


def test_currency_salary(values):
    texts = ["5 000 pln", "PLNX", "1 EUR/h", "undisclosed SALARY", "łPLN", "none"]
    assert values(T.has_currency, *texts) == [True, False, True, True, True, False]


def test_amount_salary(values):
    texts = ["1 000 – 2 000 PLN", "900\u00a0PLN", "900PLN", "a900 PLN", "900 pln", "900 PLNs", "-5 PLN"]
    assert values(T.has_amount, *texts) == [True, True, False, False, False, False, True]


def test_labels(values):
    texts = ["New", "new", "12d left", "1 D LEFT", "expires tomorrow", "Expires tomorrow.", "Senior", "Acme"]
    assert values(T.is_label, *texts) == [True, False, True, True, True, False, True, False]


def test_domains(values):
    assert values(lambda v: T.in_domain(T.id_prefix(v), ["a", "b"]), "a:/x", "c:/x", "b") == ["a", None, "b"]


def test_scorer_input_keeps_the_whole_texts(values):
    assert values(lambda v: T.scorer_input(F.lit("me"), v), "job\n") == [
        "CV MARKDOWN:\nme\n\nJOB OFFER MARKDOWN:\njob\n"
    ]


def _line(spark, stage, **counts):
    names = "discovered skipped queued_fetch fetching queued_score scoring matched rejected failed".split()
    got = {**dict.fromkeys(names, 0), **counts}
    cols = [F.lit(got[n]) for n in names]
    first = F.lit("Foo") if got["fetching"] else F.lit(None)
    second = F.lit("Bar") if got["scoring"] else F.lit(None)
    line = lines.progress_line(F.lit(stage), *cols, first, second)
    return spark.range(1).select(line.alias("l")).first()["l"]


def test_progress_lines(spark):
    assert _line(spark, "discovering", discovered=9, queued_fetch=1, fetching=1, scoring=2) == (
        "stage: mixed | discovered 9 | skipped 0 | queued-fetch 1 | fetching 1 | queued-score 0 | scoring 2 | matched 0"
        " | rejected 0 | failed 0 | current: fetching Foo, scoring Bar"
    )
    assert _line(spark, "discovering", queued_fetch=2).startswith("stage: fetching |")
    assert _line(spark, "fetching", queued_score=1).startswith("stage: scoring |")
    assert _line(spark, "discovering").startswith("stage: discovering |")
    done = _line(spark, "done", fetching=1)
    assert done.startswith("stage: done |") and done.endswith("current: fetching Foo")


def test_other_lines(spark):
    n = [F.lit(i) for i in (5, 12, 2, 0, 3, 1)]
    row = spark.range(1).select(
        lines.sync_progress_line(*n).alias("sync"),
        lines.start_line(F.lit(31)).alias("start"),
        lines.match_line(F.lit(None).cast("double"), F.lit("T"), F.lit("C"), F.lit("matched"), F.lit(""), F.lit("u")).alias("m"),
    ).first()
    assert row["sync"] == "syncing | processed 5/12 | created 2 | updated 0 | skipped 3 | failed 1"
    assert row["start"] == "Found 31 listings to process"
    assert row["m"] == "0.00 | T | C | status=matched | u"
