import json
import time

import pytest
from pyspark.sql import functions as F

from leadloom.operators import external as X
from leadloom.operators import state as S
from leadloom.operators import summary as R
from leadloom.plans.exchange import import_pages, report, sync
from leadloom.schemas import CATALOG, JOBS
from leadloom.session import work_folder
from leadloom.sources import external_pages
from leadloom.sources.external_pages import read_catalog, read_page_batches, send_changes
from leadloom.sources.state_table import StateTable

FULL = {
    "Name": "title", "External ID": "rich_text", "URL": "url", "Status": "status", "Source": "select", "Company": "rich_text",
    "Salary": "rich_text", "Location": "rich_text", "Match Score": "number", "Match Reason": "rich_text", "Summary": "rich_text",
    "Created At": "date", "Updated At": "rich_text",
}


def job(i, status="matched", **kw):
    row = dict(
        external_id=f"justjoinit:/job-offer/{i}", source="justjoinit", url=f"https://b.example/{i}", title=f"Role {i}", company="Ceramics",
        salary_text="1 PLN", location="Płock", offer_markdown="# md", match_score=0.875, match_reason="why", summary="what",
        status=status, created_at="2024-02-01T00:00:00.000Z", updated_at=f"2024-02-0{i}T00:00:00.000Z",
    )
    return tuple({**row, **kw}.values())


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), JOBS)


def catalog(spark, **changed):
    kinds = {**FULL, **{k.replace("_", " "): v for k, v in changed.items()}}
    return spark.createDataFrame([(k, v) for k, v in kinds.items() if v], CATALOG)


def rich(text):
    return {"type": "rich_text", "rich_text": [{"plain_text": t} for t in text]}


def page(i, key, **props):
    base = {
        "Name": {"type": "title", "title": [{"plain_text": "Role "}, {"plain_text": str(i)}, {}]},
        "External ID": rich([key]),
        "URL": {"type": "url", "url": f"https://b.example/{i}"},
        "Status": {"type": "status", "status": {"name": "matched"}},
    }
    merged = {**base, **{k.replace("_", " "): v for k, v in props.items()}}
    return {"id": f"page-{i}", "created_time": "2024-01-01", "last_edited_time": "2024-01-03",
            "properties": {k: v for k, v in merged.items() if v is not None}}


def landed(spark, tmp_path, *batches):
    for n, results in enumerate(batches):
        (tmp_path / f"batch-{n:05d}.json").write_text(json.dumps({"results": results, "has_more": n + 1 < len(batches)}, indent=1))
    return read_page_batches(spark, str(tmp_path))


def test_catalog(spark):
    assert X.property_kinds(catalog(spark))["Created At"] == "date"
    assert "Salary" not in X.property_kinds(catalog(spark, Salary=None))
    with pytest.raises(ValueError, match='Missing required property: "External ID"'):
        X.property_kinds(catalog(spark, External_ID=None))
    with pytest.raises(ValueError, match='Property "Status" must use one of: status, select'):
        X.property_kinds(catalog(spark, Status="rich_text"))
    with pytest.raises(ValueError, match='Optional property "Updated At" must use one of: date, rich_text'):
        X.property_kinds(catalog(spark, Updated_At="number"))
    assert X.catalog_violations(catalog(spark, URL=None, Name="url")).count() == 2


def _built(spark, kinds, **kw):
    row = jobs(spark, job(1, **kw)).select(X.build_properties(kinds).alias("p")).first()
    return json.loads(row["p"])


def test_build_properties(spark):
    text = lambda v: {"rich_text": [{"type": "text", "text": {"content": v}}]}
    built = _built(spark, FULL)
    assert list(built) == list(FULL)
    assert built["Name"] == {"title": [{"type": "text", "text": {"content": "Role 1"}}]}
    assert built["Status"] == {"status": {"name": "matched"}} and built["Source"] == {"select": {"name": "justjoinit"}}
    assert built["Match Score"] == {"number": 0.875} and built["Location"] == text("Płock")
    assert built["Created At"] == {"date": {"start": "2024-02-01T00:00:00.000Z"}}
    cleared = _built(spark, {**FULL, "Status": "select", "Source": "rich_text", "Updated At": "date"},
                     salary_text=None, match_score=None, summary="")
    assert cleared["Salary"] == cleared["Summary"] == {"rich_text": []} and cleared["Match Score"] == {"number": None}
    assert cleared["Status"] == {"select": {"name": "matched"}} and cleared["Source"] == text("justjoinit")
    assert cleared["Updated At"] == {"date": {"start": "2024-02-01T00:00:00.000Z"}}
    assert list(_built(spark, {k: FULL[k] for k in ("Name", "External ID", "URL", "Status")})) == ["Name", "External ID", "URL", "Status"]


def test_decode(spark, tmp_path):
    pages = landed(spark, tmp_path, [
        page(1, "justjoinit:/1", Salary=rich(["1", " PLN"]), Match_Score={"number": "0.9"}, Company=None),
        page(2, "other:/2"), page(3, "other:/3", Source={"select": {"name": "bulldogjob"}}, Company=rich([])),
        page(4, "justjoinit:/4", Status={"status": {"name": "unknown"}}), page(5, "bulldogjob:/5", URL={"url": ""}),
        page(6, "bulldogjob:/6", Name={"title": []}), page(7, "justjoinit:/7", Created_At={"date": {"start": "2020"}}, Updated_At=rich([]), Match_Score={"number": 0.25}),
    ])
    rows = {r["page_id"]: r for r in X.decode_pages(pages, "status", "select").collect()}
    assert [k for k, r in sorted(rows.items()) if r["valid"]] == ["page-1", "page-3", "page-7"]
    one, three, seven = rows["page-1"], rows["page-3"], rows["page-7"]
    assert (one["source"], one["title"], one["company"], one["salary_text"], one["location"], one["match_score"]) == (
        "justjoinit", "Role 1", "", "1 PLN", None, None)
    assert (one["created_at"], one["updated_at"], one["offer_markdown"]) == ("2024-01-01", "2024-01-03", None)
    assert (three["source"], three["company"]) == ("bulldogjob", "")
    assert (seven["created_at"], seven["updated_at"], seven["match_score"]) == ("2020", "", 0.25)


def test_import_replaces_rows_last_page_wins(spark, tmp_path):
    table = StateTable(spark, work_folder(spark, "jobs"))
    table.append_changes(jobs(spark, job(1), job(2)))
    key = "justjoinit:/job-offer/1"
    pages = landed(spark, tmp_path, [page(1, key), page(9, "", Name={"title": []})], [page(3, key)])
    summary = import_pages(pages, catalog(spark, Source=None), table).first().asDict()
    assert summary == {"total": 3, "imported": 2, "skipped": 1, "failed": 0}
    rows = {r["external_id"]: r for r in table.read().collect()}
    assert (rows[key]["title"], rows[key]["offer_markdown"], rows[key]["salary_text"]) == ("Role 3", None, None)
    assert rows["justjoinit:/job-offer/2"]["offer_markdown"] == "# md"
    assert R.fail_if_any(summary) is summary


def _index(spark, *rows):
    return spark.createDataFrame(list(rows), "external_id string, page_id string, synced_updated_at string")


def _counts(outcomes):
    return R.sync_summary(outcomes).first().asDict()


def test_sync_actions(spark):
    both = jobs(spark, job(1), job(2, "rejected"))
    keys = ["justjoinit:/job-offer/1", "justjoinit:/job-offer/2"]
    assert _counts(sync(both, _index(spark), catalog(spark))) == {"total": 2, "created": 2, "updated": 0, "skipped": 0, "failed": 0}
    stale = _index(spark, (keys[0], "p1", "old"), (keys[1], "p2", None))
    assert _counts(sync(both, stale, catalog(spark)))["updated"] == 2
    mixed = _index(spark, (keys[0], "p1", "2024-02-01T00:00:00.000Z"), (keys[1], "p2", "old"))
    assert _counts(sync(both, mixed, catalog(spark))) == {"total": 2, "created": 0, "updated": 1, "skipped": 1, "failed": 0}


def test_sync_isolates_failures_and_writes_changes(spark, tmp_path):
    def send(action, page_id, properties, key):
        assert key.startswith("justjoinit:")
        if "Role 1" in properties:
            raise ValueError("refused")

    outcomes = sync(jobs(spark, job(1), job(2)), _index(spark), catalog(spark), send=send)
    assert _counts(outcomes) == {"total": 2, "created": 1, "updated": 0, "skipped": 0, "failed": 1}
    assert [r["error"] for r in R.error_rows(outcomes).collect()] == ["justjoinit:/job-offer/1: refused"]
    with pytest.raises(R.JobFailed):
        R.fail_if_any(_counts(outcomes))
    sync(jobs(spark, job(1), job(2)), _index(spark), catalog(spark), out=str(tmp_path / "out"))
    assert [p.name for p in sorted((tmp_path / "out").glob("action=*"))] == ["action=create"]


def test_a_strict_sync_fails_after_all_was_sent(spark, tmp_path):
    def send(action, page_id, properties, key):
        if key.endswith("/1"):
            raise ValueError("refused")
        (tmp_path / key.rsplit("/", 1)[1]).write_text(action)

    told = []
    with pytest.raises(R.JobFailed) as failed:
        sync(jobs(spark, job(1), job(2), job(3)), _index(spark, ("justjoinit:/job-offer/3", "p3", "2024-02-03T00:00:00.000Z")), catalog(spark),
             send=send, strict=True, progress=lambda s, c: told.append((s, c)))
    assert [p.name for p in tmp_path.iterdir()] == ["2"]
    assert failed.value.summary == {"total": 3, "created": 1, "updated": 0, "skipped": 1, "failed": 1}
    assert [r["error"] for r in failed.value.errors.collect()] == ["justjoinit:/job-offer/1: refused"]
    assert told == [
        ("planned", {"total": 3, "created": 0, "updated": 0, "skipped": 1, "failed": 0}),
        ("sent", {"total": 3, "created": 1, "updated": 0, "skipped": 1, "failed": 1}),
    ]


def test_a_repeated_task_creates_nothing_twice(spark, tmp_path):
    changes = spark.createDataFrame([("k1", "create", None, "{}"), ("k2", "create", None, "{}")], "external_id string, action string, page_id string, properties_json string")

    def send(action, page_id, properties, key):
        with (tmp_path / key).open("a") as out:
            out.write(f"{action} {page_id}\n")

    def lookup(key):
        return f"page-{key}" if (tmp_path / key).exists() else None

    first = send_changes(changes.where("external_id = 'k1'"), send, lookup=lookup)
    assert first.collect()[0]["error"] is None

    # the whole task runs again, as after a lost executor
    run = external_pages._sending(send, None, lookup)
    again = next(run(iter([changes.toPandas()])))
    assert list(again["error"]) == [None, None]
    assert (tmp_path / "k1").read_text() == "create None\nupdate page-k1\n"
    assert (tmp_path / "k2").read_text() == "create None\n"


def test_unreadable_batches_fail_and_the_rest_is_imported(spark, tmp_path):
    table = StateTable(spark, work_folder(spark, "jobs"))
    key = "justjoinit:/job-offer/1"
    landed(spark, tmp_path, [page(1, key)], [page(2, key)], [page(3, key)])
    files = sorted(tmp_path.rglob("*.json"))
    files[1].write_text(files[1].read_text()[:-30])
    files[2].write_text(files[2].read_text().replace('"results": [', '"results": ["no page", ', 1))
    assert '"no page"' in files[2].read_text()
    (files[0].parent / "zz.json").write_text("<html>gateway error</html>")
    (files[0].parent / "zzz.json").write_text('{"results": [], "has_more": false}')
    pages = read_page_batches(spark, str(files[0].parent))
    summary = import_pages(pages, catalog(spark), table).first().asDict()
    assert summary["failed"] == 3 and summary["imported"] >= 1
    assert table.read().first()["external_id"] == key
    with pytest.raises(R.JobFailed) as failed:
        import_pages(pages, catalog(spark), table, strict=True)
    errors = sorted(r["error"] for r in failed.value.errors.collect())
    assert sorted(e.split(": ")[1] for e in errors) == ["batch is not readable", "batch is not readable", "entry is not a page"]
    assert summary["imported"] == 2
    assert errors[-1].startswith("zz.json#0: ")


def test_a_file_of_many_pages_is_read_in_time_of_its_size(spark, tmp_path):
    pages = landed(spark, tmp_path, [page(i, f"justjoinit:/{i}") for i in range(12_000)])
    start = time.perf_counter()
    assert pages.where("error is null").agg(F.countDistinct("pos"), F.countDistinct("id")).first() == (12_000, 12_000)
    assert time.perf_counter() - start < 30
    # no page carries the list of all pages of its batch
    assert "Generate posexplode(results" in (plan := pages._jdf.queryExecution().toString())
    assert all("results" not in line.split(", [", 1)[1] for line in plan.splitlines() if "Generate posexplode(results" in line)


def test_a_file_may_hold_a_list_of_batches(spark, tmp_path):
    for name, text in (("a", '\ufeff[{"results": [{"id": "p"}]}, {"results": [{"id": "q"}]}]'), ("b", "[]"), ("c", "[{")):
        (tmp_path / f"{name}.json").write_text(text)
    rows = read_page_batches(spark, str(tmp_path)).orderBy("batch_no", "id").collect()
    assert [(r["id"], r["pos"], r["error"]) for r in rows] == [("p", 0, None), ("q", 0, None), (None, 0, "batch is not readable")]


def test_index_takes_first_page_and_text_before_date(spark, tmp_path):
    pages = landed(spark, tmp_path, [
        page(1, "k", Updated_At={"rich_text": [{"plain_text": "t"}], "date": {"start": "d"}}), page(2, "k"),
        page(3, "m", Updated_At={"date": {"start": "d"}}), page(4, "n"),
    ])
    got = {r["external_id"]: (r["page_id"], r["synced_updated_at"]) for r in X.external_index(pages, ["batch_no", "pos"]).collect()}
    assert got == {"k": ("page-1", "t"), "m": ("page-3", "d"), "n": ("page-4", None)}


def test_a_null_text_comes_back_empty_and_counts_as_change_once(spark, tmp_path):
    kinds = X.property_kinds(catalog(spark))
    row = jobs(spark, job(1, salary_text=None))
    built = json.loads(row.select(X.build_properties(kinds).alias("p")).first()["p"])
    seen = {k: ({"rich_text": [{"plain_text": f["text"]["content"]} for f in v["rich_text"]]} if "rich_text" in v else v) for k, v in built.items()}
    seen["Name"] = {"title": [{"plain_text": "Role 1"}]}
    pages = landed(spark, tmp_path, [{"id": "p", "properties": seen}])
    back = X.import_rows(X.decode_pages(pages, "status", "select", keep=["batch_no", "pos"]), ["batch_no", "pos"])
    assert back.first()["salary_text"] == ""
    again = S.upsert_discovered(back, row.select("external_id", *S.LISTING_COLUMNS), "2030")
    assert again.first()["updated_at"] == "2030" and again.first()["salary_text"] is None


def test_catalog_file(spark, tmp_path):
    (tmp_path / "catalog.json").write_text('{"name": "Name", "type": "title"}\n')
    assert read_catalog(spark, str(tmp_path)).first()["type"] == "title"


def test_report(spark):
    assert report(jobs(spark, job(1, "rejected"))) == ["No matched jobs stored yet."]
    rows = jobs(spark, job(1, match_score=None), job(2, match_score=0.5, salary_text=None), job(3, match_score=0.5), job(4, "error"))
    assert report(rows) == [
        "0.50 | Role 3 | Ceramics | status=matched | salary=1 PLN | https://b.example/3",
        "0.50 | Role 2 | Ceramics | status=matched | https://b.example/2",
        "0.00 | Role 1 | Ceramics | status=matched | salary=1 PLN | https://b.example/1",
    ]
    assert [r["external_id"][-1] for r in R.list_jobs(rows).collect()] == ["4", "3", "2", "1"]
