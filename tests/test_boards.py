from dataclasses import replace

import pytest
from boards_data import PAGES as ROWS
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions import markup as M
from leadloom.functions import urls as U
from leadloom.functions.let import bind, let
from leadloom.plans.discover import discover, newest_landings, parse_pages
from leadloom.schemas import PAGES, RunConfig, default_config
from leadloom.sources import boards as B
from leadloom.session import stage
from leadloom.sources.pages import read_pages, scan_pages


def _pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None) for r in rows], PAGES)


def _config(cap=200, **enabled):
    base = default_config()
    return RunConfig(
        tuple(replace(s, max_listings=cap, enabled=enabled.get(s.source, True)) for s in base.sources)
    )


def _found(spark, config, **kw):
    rows = discover(_pages(spark), config, **kw).collect()
    return {r["external_id"]: r for r in rows}


def test_listings_of_all_boards(spark):
    found = _found(spark, _config(), strict=True)
    fields = {k: (r["title"], r["company"], r["salary_text"], r["location"]) for k, r in found.items()}
    assert fields == {
        # Repeated on its page: the place of the first card, the values of the last.
        "justjoinit:/job-offer/tram-driver-lublin": ("Tram Driver II", "City Rail", "50 EUR", "Lublin"),
        "justjoinit:/job-offer/baker-torun": ("Baker", "Loaf Ltd", None, None),
        "nofluffjobs:/pl/job/potter-kielce": ("Potter (clay)", "Clay Works", "4 100 - 5 200 PLN", "Kielce"),
        "nofluffjobs:/pl/job/smith-zory": ("Smith", "Iron", None, "Żory"),
        # Page 2 has no mark for more pages, so page 3 is never asked for.
        "nofluffjobs:/pl/job/weaver-lodz": ("Weaver", "Loom", None, "Łódź"),
        "bulldogjob:/companies/jobs/11-glazier": ("Glazier", "Glass Co", None, "Opole"),
        "bulldogjob:/companies/jobs/12-cook": ("Cook", "Soup House", None, None),
        "bulldogjob:/companies/jobs/13-miner": ("Miner", "Coal", None, "Zabrze"),
    }
    tram = found["justjoinit:/job-offer/tram-driver-lublin"]
    assert (tram["pos"], tram["url"]) == (0, "https://justjoin.it/job-offer/tram-driver-lublin")


def test_first_card_without_repeat_keeps_its_salary(spark):
    pages = _pages(spark).where("source = 'justjoinit'").withColumn("base_url", F.lit("https://justjoin.it"))
    rows = B.read_cards(pages, {"justjoinit": B.FLAT})
    first = rows.orderBy("pos").first()
    assert (first["title"], first["salary_text"], first["location"]) == (
        "Tram Driver & Mechanic", "7 000 - 9 000 PLN/month", "Lublin, +2Locations",
    )


def test_cap_counts_in_page_order(spark):
    found = _found(spark, _config(cap=2))
    assert sorted(found) == [
        "bulldogjob:/companies/jobs/11-glazier", "bulldogjob:/companies/jobs/12-cook",
        "justjoinit:/job-offer/baker-torun", "justjoinit:/job-offer/tram-driver-lublin",
        "nofluffjobs:/pl/job/potter-kielce", "nofluffjobs:/pl/job/smith-zory",
    ]


def test_one_source(spark):
    assert {r["source"] for r in _found(spark, _config(), source="nofluffjobs").values()} == {"nofluffjobs"}


def test_source_selection():
    config = _config(justjoinit=False)
    assert [s.source for s in B.select_sources(config)] == ["nofluffjobs", "bulldogjob"]
    with pytest.raises(ValueError, match='Source "justjoinit" is disabled in config'):
        B.select_sources(config, "justjoinit")
    with pytest.raises(ValueError, match="not configured"):
        B.select_sources(config, "other")


def test_strict_mode_misses_a_page(spark):
    without = [r for r in ROWS if not (r[0] == "bulldogjob" and r[1] == 3)]
    with pytest.raises(RuntimeError, match="bulldogjob"):
        discover(_pages(spark, without), _config(), strict=True)
    with pytest.raises(RuntimeError, match="justjoinit"):
        discover(_pages(spark, ROWS[1:]), _config(), strict=True)
    # Enough listings: the missing page is not needed.
    discover(_pages(spark, without), _config(cap=3), strict=True)


def test_strict_scan_names_the_address(spark):
    targets = B.frontier(spark, _config(cap=2).sources[1])
    assert scan_pages(targets, _pages(spark), strict=True).count() == 2
    with pytest.raises(Exception, match="Request failed for .*skills,JavaScript/page,2"):
        scan_pages(B.frontier(spark, _config(cap=2).sources[2]), _pages(spark, ROWS[:5]), strict=True).select(
            F.max("html")
        ).collect()


def test_earlier_source_wins_across_boards(spark):
    twin = B.Board(B.BOARDS["bulldogjob"].search_url, lambda p: B.read_cards(p, {"bulldogjob": B.BLOCKS}).withColumn(
        "external_id", F.lit("nofluffjobs:/pl/job/smith-zory")))
    config = replace(_config(), sources=_config().sources[1:])
    found = {
        r["external_id"]: r["title"]
        for r in discover(_pages(spark), config, boards={**B.BOARDS, "bulldogjob": twin}).collect()
    }
    assert found["nofluffjobs:/pl/job/smith-zory"] == "Smith"
    assert len(found) == 3


def _old(html):
    return html.replace("Miner", "Old Miner").replace("Weaver", "Old Weaver").replace("Baker", "Old Baker")


def _landed(spark, tmp_path, *landings):
    """Pages written as a folder by landing and read back; None writes them without one."""
    for time, rows in landings:
        df = spark.createDataFrame([r[:4] for r in rows], "source string, page_no int, url string, html string")
        if time is not None:
            df = df.withColumn("landed_at", F.lit(time))
        df.write.mode("append").partitionBy(*(["landed_at"] if time else [])).parquet(str(tmp_path / ("by" if time else "plain")))
    return read_pages(spark, str(tmp_path / ("by" if landings[0][0] else "plain")))


def test_the_last_landing_counts_through_the_reader(spark, tmp_path):
    once = discover(_pages(spark), _config()).orderBy("external_id").collect()
    old = [(*r[:3], _old(r[3])) for r in ROWS]
    pages = _landed(spark, tmp_path, ("2026-01-02T00:00:00Z", ROWS), ("2026-01-01T00:00:00Z", old))
    assert discover(pages, _config()).orderBy("external_id").collect() == once
    # a page that only an older landing has is that landing's
    part = [r for r in ROWS if r[0] != "bulldogjob"]
    pages = _landed(spark, tmp_path / "part", ("2026-01-02T00:00:00Z", part), ("2026-01-01T00:00:00Z", old))
    titles = {r["title"] for r in discover(pages, _config()).collect()}
    assert "Old Miner" in titles and "Weaver" in titles and "Old Weaver" not in titles


def test_pages_without_a_landing_are_the_oldest(spark, tmp_path):
    once = discover(_pages(spark), _config()).orderBy("external_id").collect()
    pages = _landed(spark, tmp_path, (None, ROWS))
    assert discover(pages, _config()).orderBy("external_id").collect() == once
    old = pages.withColumn("html", F.replace("html", F.lit("Miner"), F.lit("Old Miner")))
    new = pages.withColumn("landed_at", F.lit("2026"))
    assert discover(old.unionByName(new), _config()).orderBy("external_id").collect() == once
    assert discover(pages.drop("landed_at"), _config()).orderBy("external_id").collect() == once


def _nodes(df):
    """Name and output columns of the physical operators of a plan that has not run."""
    out, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        out.append((node.nodeName(), node.output().mkString(",")))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_markup_is_scanned_once_and_never_shuffled(spark, tmp_path):
    pages = _landed(spark, tmp_path, ("2026-01-02T00:00:00Z", ROWS), ("2026-01-01T00:00:00Z", ROWS))
    chosen = list(_config().sources)
    newest = stage(newest_landings(pages, chosen), "landings")
    rows = parse_pages(pages, newest, chosen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        nodes = _nodes(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("html" in output for name, output in nodes if name.startswith("Scan parquet")) == 1
    assert "landed_at" in next(x for x in plan.split("\n") if "html" in x and "FileScan" in x).split("PartitionFilters")[1]
    moved = [output for name, output in nodes if name in ("SortMergeJoin", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Exchange")]
    assert moved and not any("html" in output for output in moved)


def test_repeated_landings_change_nothing(spark):
    once = {r["external_id"] for r in discover(_pages(spark), _config()).collect()}
    pages = _pages(spark)
    assert {r["external_id"] for r in discover(pages.unionByName(pages), _config()).collect()} == once


def test_selected_sources_keep_their_rank(spark, tmp_path):
    from leadloom.bindings.discovery import source_select

    rows = [("s2", "en"), ("s10", "en"), ("s10", "de"), ("s3", "de")]
    spark.createDataFrame(rows, "source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = source_select(spark, str(tmp_path)).select("source", "source_rank", "max_listings").collect()
    assert [tuple(r) for r in found] == [("s2", 2, 1), ("s10", 10, 2)]


def test_cards_are_read_in_one_python_step(spark):
    pages = _pages(spark).withColumn("base_url", F.lit("https://x.example"))
    plan = B.read_cards(pages, {"bulldogjob": B.BLOCKS})._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("MapInArrow") == 1 and "lambdafunction" not in physical


def test_card_reader_agrees_with_the_column_functions(spark):
    cards = (
        "<a href=' /b/../é x?q=1#f'><div><p>one<p>two<b>&#x142;&amp;lt;</div></i><h3>T\ufeff\u00a0 t</h3><br/><span/></a>",
        "<a HREF=//H.Ex/p&#65279;><ul><li>a<li>b</ul></section><svg><path d='m'/></svg><!x><div><i>1</i>c</div></a>",
        "<a href='HTTP://ABC.ex'>bare</a>", "<a href='?z'><div></a>",
    )
    href = H.attribute(F.col("card"), "href")
    url = U.resolve(href, F.lit("https://s.example/f/g?h#i"))
    fields = bind(
        spark.createDataFrame([(i, c) for i, c in enumerate(cards)], "i int, card string"),
        let(H.tokens(H.inner(F.col("card"))), H.tree),
        lambda t: F.struct(
            t["names"].alias("names"), H.element_text(t, F.lit(1)).alias("text"), H.close_of(t, H.find_open(t, "div")).alias("close"),
            F.transform(H.leaf_texts(t), lambda x: x["text"]).alias("leaves"), url.alias("url"), U.pathname(url).alias("path"),
        ),
    )
    for row in fields.orderBy("i").collect():
        card, div = M.Card(row["card"]), M.Card(row["card"]).find("div")
        mine = M.resolved(M.attribute(row["card"], M._HREF), "https://s.example/f/g?h#i")
        assert card.names == row["names"]
        assert (card.text(1) if card.names else None) == row["text"]
        assert (div and card.close(div)) == row["close"]
        assert card.leaves() == row["leaves"]
        assert (mine, M.pathname(mine)) == (row["url"], row["path"])
