import os

import pytest

from leadloom import session
from leadloom.session import clear_work, stage, work_folder


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class _Session:
    def __init__(self, master, folder=None):
        self.conf = _Conf(folder)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "fake"})()


def test_the_shared_folder_is_used():
    a, b = (work_folder(_Session("spark://h:7077", "s3a://b/work/"), "x") for _ in range(2))
    assert a.startswith("s3a://b/work/x-") and a != b


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder(_Session("spark://h:7077"), "x")


def test_a_local_master_may_use_a_local_folder():
    folder = work_folder(_Session("local[2]"), "x")
    assert os.path.dirname(folder) == session._local_base()


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, [1.5])], "a int, b array<double>")
    staged = stage(df, "t")
    assert staged.schema == df.schema and sorted(r["a"] for r in staged.collect()) == [1, 2]
    assert "LocalTableScan" not in staged._jdf.queryExecution().executedPlan().toString()


def test_work_folders_are_removed_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(session, "_given", {})
    staged = stage(spark.range(3), "t")
    [folder] = {os.path.dirname(f.removeprefix("file://")) for f in staged.inputFiles()}
    never_written = work_folder(spark, "t")
    assert os.path.isdir(folder) and not os.path.exists(never_written)
    assert clear_work(spark) == 2 and not os.path.exists(folder)
    assert clear_work(spark) == 0
