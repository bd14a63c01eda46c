import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.operators import listing as L


def _walk(pages, cap):
    """The crawl loop, page by page."""
    kept, total, number = [], 0, 1
    while total < cap:
        page = pages.get(number)
        if not page or page[0] == 0:
            break
        kept.append((number, total))
        total += page[0]
        if page[1]:
            break
        number += 1
    return kept


def _prefix(spark, groups, cap, **kw):
    rows = [(g, p, n, last) for g, pages in groups.items() for p, (n, last) in pages.items()]
    df = spark.createDataFrame(rows, "source string, page_no int, n int, last boolean")
    got = L.page_prefix(df, cap, last="last", **kw).select("source", "page_no", "before").collect()
    return sorted(tuple(r) for r in got)


def _expected(groups, cap):
    return sorted((g, p, b) for g, pages in groups.items() for p, b in _walk(pages, cap))


def _groups(rng, size):
    groups = {}
    for g in "abcd":
        pages = {p: (rng.choice([1, 2, 3, 9]) if rng.random() > 0.03 else 0, rng.random() < 0.03) for p in range(1, size)}
        if rng.random() < 0.5:
            pages.pop(rng.randrange(1, size), None)
        groups[g] = pages
    return groups


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 7, 40, 10_000]))
def test_prefix_equals_the_crawl_loop(spark, seed, cap):
    groups = _groups(random.Random(seed), 40)
    assert _prefix(spark, groups, cap) == _expected(groups, cap)


def test_prefix_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 5)
    for seed in range(3):
        groups = _groups(random.Random(seed), 60)
        groups["long"] = {p: (2, False) for p in range(1, 200)}
        assert _prefix(spark, groups, 300) == _expected(groups, 300)


def test_prefix_with_a_cap_per_group(spark):
    rows = [(g, p, 3, 4 if g == "a" else 8) for g in "ab" for p in range(1, 6)]
    df = spark.createDataFrame(rows, "source string, page_no int, n int, cap int")
    kept = L.page_prefix(df, "cap")
    assert sorted((r["source"], r["page_no"]) for r in kept.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    cards = spark.createDataFrame([(g, p, i) for g in "ab" for p in range(1, 6) for i in range(3)], "source string, page_no int, pos int")
    capped = L.cap_rows(cards, kept, "cap").groupBy("source").count()
    assert {r["source"]: r["count"] for r in capped.collect()} == {"a": 4, "b": 8}
    assert L.unfinished(df, kept, "cap").count() == 0
    short = L.page_prefix(df.withColumn("cap", F.lit(99)), "cap")
    assert {r["missing_page"] for r in L.unfinished(df, short, "cap").collect()} == {6}


def test_first_and_last_row_of_a_hot_key(spark):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("o"),
        F.when(F.col("id") == 0, None).otherwise(F.col("id")).alias("v"),
    )
    first = L.dedupe_first(hot, ["k"], ["o"]).where("k = 'hot'").first()
    last = L.collapse_last(hot, ["k"], ["o"]).where("k = 'hot'").first()
    both = L.collapse_last_value(hot, ["k"], "o").where("k = 'hot'").first()
    assert (first["o"], first["v"]) == (0, None)
    assert (last["o"], last["v"]) == (29_997, 29_997)
    assert (both["o"], both["v"]) == (0, 29_997)
    assert L.dedupe_first(hot, ["k"], ["o"]).count() == 20_001


def test_union_keeps_order_and_fills_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,)], "i int")
    assert sorted(map(tuple, L.union_sources([a, b]).collect())) == [(1, "x", 1), (2, None, 2)]
