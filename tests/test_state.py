from leadloom.operators import state as S
from leadloom.schemas import JOBS
from leadloom.session import work_folder
from leadloom.sources.state_table import StateTable

T1, T2 = "2024-01-01T00:00:00.000Z", "2024-01-01T00:05:00.000Z"
LISTING = "external_id string, source string, url string, title string, company string, salary_text string, location string"


def listing(i, company="Co", salary=None):
    return (f"s:/{i}", "s", f"https://s.example/{i}", f"Role {i}", company, salary, "Here")


def listings(spark, *rows):
    return spark.createDataFrame(list(rows), LISTING)


def by_id(df):
    return {r["external_id"]: r for r in df.collect()}


def test_upsert_inserts_then_detects_change(spark):
    state = S.upsert_discovered(S.empty_state(spark), listings(spark, listing(1), listing(2)), T1)
    assert {r["status"] for r in state.collect()} == {"discovered"}
    again = S.upsert_discovered(state, listings(spark, listing(1), listing(2, salary="9 PLN"), listing(3)), T2)
    rows = by_id(again)
    assert (rows["s:/1"]["updated_at"], rows["s:/2"]["updated_at"]) == (T1, T2)
    assert (rows["s:/2"]["created_at"], rows["s:/2"]["salary_text"]) == (T1, "9 PLN")
    assert rows["s:/3"]["created_at"] == T2
    assert again.schema.names == state.schema.names


def test_an_empty_text_is_a_change_against_null(spark):
    state = S.upsert_discovered(S.empty_state(spark), listings(spark, listing(1, salary="")), T1)
    assert by_id(S.upsert_discovered(state, listings(spark, listing(1)), T2))["s:/1"]["updated_at"] == T2


def test_upsert_keeps_status_and_results(spark):
    state = S.upsert_discovered(S.empty_state(spark), listings(spark, listing(1)), T1)
    done = spark.createDataFrame([("s:/1", "# md", 0.9, "r", "sum", "matched")],
                                 "external_id string, offer_markdown string, match_score double, match_reason string, summary string, status string")
    state = S.apply_updates(state, done, T1)
    row = by_id(S.upsert_discovered(state, listings(spark, listing(1, "New Co")), T2))["s:/1"]
    assert (row["company"], row["status"], row["offer_markdown"], row["match_score"]) == ("New Co", "matched", "# md", 0.9)


def test_states_of_one_job(spark):
    state = S.upsert_discovered(S.empty_state(spark), listings(spark, listing(1)), T1)
    step = lambda s: spark.createDataFrame([("s:/1", s), ("s:/none", s)], "external_id string, status string")
    state = S.apply_updates(state, step("fetching"), T2)
    assert by_id(state)["s:/1"]["updated_at"] == T2
    fetched = spark.createDataFrame([("s:/1", "# md", "fetched")], "external_id string, offer_markdown string, status string")
    state = S.apply_updates(S.apply_updates(state, fetched, T2), step("error"), T2)
    row = by_id(state)["s:/1"]
    assert (row["status"], row["offer_markdown"]) == ("error", "# md")
    assert state.count() == 1


def test_replace_brings_nulls_and_times(spark):
    state = S.upsert_discovered(S.empty_state(spark), listings(spark, listing(1, salary="x"), listing(2)), T1)
    new = [("s:/1", "s", "u", "t", "", None, None, None, None, None, None, "scored", "", "any text")]
    rows = by_id(S.upsert_replace(state, spark.createDataFrame(new, JOBS)))
    assert (rows["s:/1"]["salary_text"], rows["s:/1"]["created_at"], rows["s:/1"]["updated_at"]) == (None, "", "any text")
    assert rows["s:/2"]["updated_at"] == T1


def test_skip_and_lookup(spark):
    state = spark.createDataFrame([("s:/1", "matched"), ("s:/2", "rejected"), ("s:/3", "error"), ("s:/4", "scoring")], "external_id string, status string")
    rows = listings(spark, *[listing(i) for i in range(1, 6)])
    assert sorted(by_id(S.incremental_skip(rows, state))) == ["s:/3", "s:/4", "s:/5"]
    assert by_id(S.status_lookup(rows, state))["s:/5"]["status"] is None
    assert sorted(by_id(S.known_rows(rows, state))) == ["s:/1", "s:/2", "s:/3", "s:/4"]
    open_rows = S.status_lookup(rows, state)
    assert open_rows.where(S.needs_work(open_rows["status"])).count() == 3


def test_state_table_versions(spark):
    table = StateTable(spark, work_folder(spark, "t"), buckets=3, compact_after=4)
    assert table.read().count() == 0 and table.read().schema.names == S.empty_state(spark).schema.names
    first = S.upsert_discovered(table.read(), listings(spark, *[listing(i) for i in range(50)]), T1)
    table.write_full(first)
    for n in range(1, 4):
        change = listings(spark, *[listing(i, f"Co {n}") for i in range(n * 10)])
        table.append_changes(S.upsert_discovered(table.rows_of(change), change, T2, how="right_outer"), f"batch-{n}")
    assert table.append_changes(first, "batch-2") is None
    rows = by_id(table.read())
    assert len(rows) == 50 == table.count()
    assert (rows["s:/5"]["company"], rows["s:/29"]["company"], rows["s:/30"]["company"]) == ("Co 3", "Co 3", "Co")
    kinds = [v[1] for v in table.versions()]
    assert kinds == ["full", "changes", "changes", "changes"]
    table.append_changes(first.where("external_id = 's:/0'"))
    assert [v[1] for v in table.versions()][-1] == "full"
    assert by_id(table.read())["s:/0"]["company"] == "Co" and table.count() == 50
    # Another session finds the same table by its path.
    assert StateTable(spark, table.path).count() == 50


def test_a_version_without_success_mark_does_not_count(spark):
    table = StateTable(spark, work_folder(spark, "t"))
    table.append_changes(S.upsert_discovered(table.read(), listings(spark, listing(1)), T1))
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/v00000002-changes-b4")
    assert table.count() == 1


def test_the_stored_table_is_not_shuffled(spark):
    table = StateTable(spark, work_folder(spark, "t"), buckets=4)
    table.write_full(S.upsert_discovered(table.read(), listings(spark, listing(1)), T1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.rows_of(listings(spark, listing(1)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_change_set_holds_changes_only(spark):
    table = StateTable(spark, work_folder(spark, "t'quoted"), buckets=4)
    rows = listings(spark, *[listing(i) for i in range(20)])
    table.append_changes(S.upsert_discovered(table.rows_of(rows), rows, T1, how="right_outer"))
    assert S.upsert_discovered(table.rows_of(rows), rows, T2, how="right_outer").count() == 0
    some = listings(spark, listing(1, salary="9 PLN"), listing(2), listing(99))
    assert sorted(by_id(S.upsert_discovered(table.rows_of(some), some, T2, how="right_outer"))) == ["s:/1", "s:/99"]


def test_compaction_by_bucket_and_into_other_buckets(spark):
    table = StateTable(spark, work_folder(spark, "t'quoted"), buckets=3)
    table.append_changes(S.upsert_discovered(table.read(), listings(spark, *[listing(i) for i in range(60)]), T1))
    table.compact()
    change = listings(spark, *[listing(i, "New Co") for i in range(30, 90)])
    table.append_changes(S.upsert_discovered(table.rows_of(change), change, T2, how="right_outer").repartition(7))
    table.compact()
    number, kind, buckets, _, folder = table.versions()[-1]
    assert (kind, buckets) == ("full", 3) and len(spark.read.parquet(folder).inputFiles()) <= 6
    table.compact(buckets=5)
    assert table.versions()[-1][1:3] == ("full", 5) and table.count() == 90
    assert sum(r["company"] == "New Co" for r in table.read().collect()) == 60


def test_old_versions_expire(spark):
    table = StateTable(spark, work_folder(spark, "t"), "external_id string, n int", buckets=2)

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "external_id string, n int")

    table.write_full(rows(("a", 1)))
    table.append_changes(rows(("b", 1)), "t1")
    table.compact()
    table.append_changes(rows(("a", 2)), "t2")
    table.compact()
    table.append_changes(rows(("c", 3)))
    before = sorted(tuple(r) for r in table.read().collect())
    held = table.read()
    assert table.expire(keep=1) == []  # all written just now
    assert table.expire(keep=2, min_age=0) == [1, 2]
    assert sorted(tuple(r) for r in held.collect()) == before == [("a", 2), ("b", 1), ("c", 3)]
    names = [table._name(f"{table.path}/v00000001-full-b2")]
    assert not any(t.name in names for t in spark.catalog.listTables())
    assert table.expire(keep=1, min_age=0) == [3, 4]
    assert [v[0] for v in table.versions()] == [5, 6]
    assert sorted(tuple(r) for r in table.read().collect()) == before
    table.compact()
    assert sorted(tuple(r) for r in table.read().collect()) == before


def test_a_table_as_it_was_before_a_write(spark):
    table = StateTable(spark, work_folder(spark, "t"), "external_id string, n int", buckets=2)
    for n, tag in enumerate(("t0", "t1", "t2")):
        table.append_changes(spark.createDataFrame([("a", n)], "external_id string, n int"), tag)
    assert [[r["n"] for r in table.read(before=tag).collect()] for tag in ("t0", "t1", "t2", "t3")] == [[], [0], [1], [2]]
