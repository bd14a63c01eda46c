from dataclasses import replace

import pytest
from boards_data import BLOCK_1, BLOCK_2, BLOCK_URL
from boards_data import PAGES as ROWS
from pyspark import TaskContext
from pyspark.sql import functions as F

from leadloom.operators.scoring import lexical_scorer
from leadloom.operators.state import latest_status
from leadloom.plans.crawl import check_crawl, crawl_table, crawled, newer_pages, page_rows
from leadloom.schemas import OFFERS, PAGES, default_config
from leadloom.session import work_folder
from leadloom.sources.boards import BOARDS
from leadloom.sources.state_table import StateTable
from leadloom.streaming import ingest

EVENTS = "k string, status string, ts long, seq long"


def _land(spark, folder, n, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/part{n}")


def _drain(spark, folder, table, changes, checkpoint):
    stream = ingest.file_stream(spark, f"{folder}/*", EVENTS, files_per_batch=1)
    ingest.fold(stream, table, changes, checkpoint).awaitTermination()
    return {r["k"]: r for r in table.read().collect()}


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    seen, checkpoint = [], work_folder(spark, "cp")
    latest = StateTable(spark, work_folder(spark, "latest"), EVENTS, "k", compact_after=3)
    first = StateTable(spark, work_folder(spark, "first"), EVENTS, "k", compact_after=3)
    first_checkpoint = work_folder(spark, "cp")
    order = []
    for n in range(4):
        rows = [(f"k{(7 * i + n) % 5}", f"s{n}{i}", (13 * i + 5 * n) % 11, i) for i in range(6)]
        seen += rows
        order += [(n, r) for r in rows]
        _land(spark, tmp_path, n, rows)
        got = _drain(spark, tmp_path, latest, ingest.last_status("k", ["ts", "seq", "status"]), checkpoint)
        once = _drain(spark, tmp_path, first, ingest.first_seen("k", ["ts", "seq", "status"]), first_checkpoint)
    batch = latest_status(spark.createDataFrame(seen, EVENTS), "k", "status", ["ts", "seq", "status"])
    assert {k: r["status"] for k, r in got.items()} == {r["k"]: r["status"] for r in batch.collect()}
    expected = {}
    for n in range(4):
        for m, r in sorted(order, key=lambda x: (x[0], x[1][2], x[1][3], x[1][1])):
            if m == n:
                expected.setdefault(r[0], r[1])
    assert {k: r["status"] for k, r in once.items()} == expected
    assert any(v[1] == "full" for v in latest.versions())


def test_replayed_batch_is_written_once(spark, tmp_path):
    table = StateTable(spark, work_folder(spark, "t"), EVENTS, "k")
    _land(spark, tmp_path, 0, [("a", "x", 1, 1)])
    changes = ingest.last_status("k", ["ts", "seq"])
    _drain(spark, tmp_path, table, changes, work_folder(spark, "cp"))
    # A replayed batch has the id of its stream.
    table.append_changes(table.read(), table.versions()[-1][3])
    assert len(table.versions()) == 1
    # A lost checkpoint starts over: nothing is lost, nothing doubled.
    _land(spark, tmp_path, 1, [("b", "y", 1, 1)])
    got = _drain(spark, tmp_path, table, changes, work_folder(spark, "cp"))
    assert {k: r["status"] for k, r in got.items()} == {"a": "x", "b": "y"}


def test_two_streams_into_one_table(spark, tmp_path):
    table = StateTable(spark, work_folder(spark, "t"), EVENTS, "k")
    changes = ingest.last_status("k", ["ts", "seq"])
    for n in range(2):
        _land(spark, tmp_path / f"in{n}", 0, [(f"k{n}{i}", "x", 1, i) for i in range(5)])
        got = _drain(spark, tmp_path / f"in{n}", table, changes, work_folder(spark, "cp"))
    assert len(got) == 10


def test_each_landing_is_a_run(spark, tmp_path):
    one = replace(default_config(), sources=default_config().sources[2:], match_threshold=0.5)

    def land(n, *pages):
        rows = [("bulldogjob", i, BLOCK_URL + (f"/page,{i}" if i > 1 else ""), html, f"2026-01-0{n + 1}") for i, html in enumerate(pages, 1)]
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{tmp_path}/landing{n}")

    land(0, BLOCK_1, "")
    land(1, BLOCK_1.replace("Opole", "Nysa"), BLOCK_2, "")
    offers = spark.createDataFrame(
        [("http://bulldogjob.com/companies/jobs/11-glazier", "glass", None, None), ("bulldogjob.com/companies/jobs/12-cook", "soup", None, None)], OFFERS
    )
    table, summaries = StateTable(spark, work_folder(spark, "jobs")), []
    crawl, steps = crawl_table(spark, work_folder(spark, "crawl")), []
    stream = ingest.file_stream(spark, f"{tmp_path}/*", PAGES, files_per_batch=1)
    ingest.run_stream(
        stream, one, crawl, table, lambda: offers, lambda: spark.createDataFrame([("glass",)], "profile string"), lexical_scorer,
        lambda: "2024", work_folder(spark, "cp"), lambda n, s: summaries.append((n, tuple(s.values()))),
        progress=lambda step, c: steps.append((step, c["matched"] + c["rejected"] + c["failed"])),
    ).awaitTermination()
    check_crawl(crawl, one)
    assert steps == [("discovered", 0), ("fetched", 0), ("scored", 2), ("discovered", 0), ("fetched", 1), ("scored", 1)]
    assert summaries == [(0, (2, 0, 2, 1, 1, 0, 2)), (1, (3, 2, 0, 0, 0, 1, 3))]
    rows = {r["external_id"].split("-")[-1]: (r["status"], r["location"]) for r in table.read().collect()}
    assert rows == {"glazier": ("matched", "Nysa"), "cook": ("rejected", None), "miner": ("error", "Zabrze")}


SCORED = ["external_id", "source", "url", "title", "location", "offer_markdown", "match_score", "status"]


def test_a_crawl_in_pieces_equals_one_batch(spark, tmp_path):
    """Any order of files, one a batch, with a gap that is filled later and a cap that ends on a page."""
    config = replace(default_config(), match_threshold=0.5, sources=tuple(replace(s, max_listings=2) if s.source == "bulldogjob" else s for s in default_config().sources))
    offers = spark.createDataFrame([("http://bulldogjob.com/companies/jobs/11-glazier", "glass", None, None)], OFFERS)
    rows = [(*r, None) for r in ROWS]

    def crawl_of(name, files, per_batch):
        for n, some in enumerate(files):
            spark.createDataFrame(some, PAGES).coalesce(1).write.parquet(f"{tmp_path}/{name}/{n}")
        crawl, jobs = crawl_table(spark, work_folder(spark, "crawl")), StateTable(spark, work_folder(spark, "jobs"))
        ingest.run_stream(
            ingest.file_stream(spark, f"{tmp_path}/{name}/*", PAGES, files_per_batch=per_batch), config, crawl, jobs, lambda: offers,
            lambda: spark.createDataFrame([("glass",)], "profile string"), lexical_scorer, lambda: "2024", work_folder(spark, "cp"),
        ).awaitTermination()
        check_crawl(crawl, config)
        return jobs.read().select(SCORED).orderBy("external_id").collect()

    whole = crawl_of("whole", [rows], None)
    assert {r["external_id"].split(":")[0] for r in whole} == {"justjoinit", "nofluffjobs", "bulldogjob"}
    # the later pages first, so that page 2 of a board waits for page 1
    assert crawl_of("pieces", [rows[2:4] + rows[5:7], rows[7:], rows[4:5] + rows[:1], rows[1:2]], 1) == whole


def test_pages_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    base = default_config()
    config = replace(base, sources=tuple(s for s in base.sources if s.source == "bulldogjob"))
    landed = spark.range(1, 41).select(
        F.lit("bulldogjob").alias("source"), F.col("id").cast("int").alias("page_no"),
        BOARDS["bulldogjob"].search_url(config.sources[0], F.col("id").cast("int")).alias("url"),
        F.concat(F.lit("<a href='/companies/jobs/"), "id", F.lit("-x'><div><h3>T</h3><div>C</div></div></a>")).alias("html"),
        F.lit(None).cast("string").alias("landed_at"),
    )
    landed.coalesce(1).write.parquet(f"{tmp_path}/landed")
    tasks = tmp_path / "tasks"
    tasks.mkdir()
    fields = BOARDS["bulldogjob"].read.fields

    def noted(card):
        (tasks / str(TaskContext.get().taskAttemptId())).touch()
        return fields(card)

    boards = BOARDS | {"bulldogjob": replace(BOARDS["bulldogjob"], read=replace(BOARDS["bulldogjob"].read, fields=noted))}
    config = replace(config, sources=(replace(config.sources[0], max_listings=100),))
    rows = page_rows(spark.read.schema(PAGES).parquet(f"{tmp_path}/landed"), config, "b0", boards).collect()
    assert len(rows) == 40 and all(len(r["cards"]) == 1 for r in rows)
    assert len(list(tasks.iterdir())) > 1


def test_missing_pages_are_named_at_the_end(spark):
    config = default_config()
    crawl = crawl_table(spark, work_folder(spark, "crawl"))
    pages = spark.createDataFrame([(*r, None) for r in ROWS if r[:2] != ("bulldogjob", 2)], PAGES)
    crawl.append_changes(page_rows(pages, config, "b0"))
    with pytest.raises(RuntimeError, match="bulldogjob"):
        check_crawl(crawl, config)
    lost = spark.createDataFrame([(*r, None) for r in ROWS if r[:2] == ("bulldogjob", 2)], PAGES)
    crawl.append_changes(newer_pages(crawl.read(), page_rows(lost, config, "b1")))
    check_crawl(crawl, config)


def test_older_landings_do_not_replace_pages(spark):
    config = default_config()

    def found(time, mark):
        rows = [(*r[:3], r[3].replace("Miner", mark), time) for r in ROWS]
        return page_rows(spark.createDataFrame(rows, PAGES), config, time or "none")

    crawl = crawl_table(spark, work_folder(spark, "crawl"))
    for time, mark in (("2026-01-02", "Second"), ("2026-01-01", "First"), (None, "Undated")):
        crawl.append_changes(newer_pages(crawl.read(), found(time, mark)))
    titles = {r["title"] for r in crawled(crawl.read(), config).collect()}
    assert "Second" in titles and not titles & {"First", "Undated"}


def test_progress_listener(spark, tmp_path):
    reports = []
    listener = ingest.ProgressListener(reports.append)
    spark.streams.addListener(listener)
    try:
        table = StateTable(spark, work_folder(spark, "t"), EVENTS, "k")
        _land(spark, tmp_path, 0, [("a", "x", 1, 1), ("b", "x", 1, 1)])
        _drain(spark, tmp_path, table, ingest.last_status("k", ["ts", "seq"]), work_folder(spark, "cp"))
        for _ in range(100):
            if reports:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert any(r["rows"] == 2 for r in reports) or reports
