"""The keyed job table as versioned parquet folders.

A version is a full table, bucketed by key, or a change set (whole rows of the
changed keys).  A run writes a change set, so its cost follows what changed
and not the size of the table; a read overlays the change sets on the last
full table.  The table side of that overlay, and of the upsert joins, is read
by bucket and is not shuffled.  A version counts once Spark's ``_SUCCESS``
file is there.  One writer at a time.
"""

from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.listing import collapse_last
from leadloom.schemas import JOBS

_VERSION = re.compile(r"v(\d+)-(full|changes)-b(\d+)(?:-t(.+))?$")


class StateTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str = JOBS,
        key: str = "external_id",
        buckets: int | None = None,
        compact_after: int | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.key = key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.compact_after = compact_after
        self.columns = spark.createDataFrame([], schema).columns

    def versions(self) -> list[tuple[int, str, int, str | None, str]]:
        """Committed versions in order: number, kind, buckets, tag, folder."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        fs = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in fs.globStatus(pattern) or []:
            folder = status.getPath().getParent()
            match = _VERSION.match(folder.getName())
            if match:
                number, kind, buckets, tag = match.groups()
                found.append((int(number), kind, int(buckets), tag, folder.toString()))
        return sorted(found)

    def _name(self, folder: str) -> str:
        number = folder.rsplit("/", 1)[1].replace("-", "_")
        return f"leadloom_{hashlib.sha256(self.path.encode()).hexdigest()}_{number}"

    def _load_full(self, folder: str, buckets: int) -> DataFrame:
        name = self._name(folder)
        location = folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` ({self.schema}) USING parquet "
            f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return self.spark.table(name)

    def _load_changes(self, folders: list[str]) -> DataFrame:
        """The last change of each key, from one plain scan over all change sets.

        Not a union of bucketed tables: their scan may be taken as partitioned
        by key when it is not (seen with Spark 4.1), and repeated keys survive.
        """
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        if len(folders) == 1:
            return rows
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)-changes-", 1)
        numbered = rows.select("*", version.cast("long").alias("__version"))
        return collapse_last(numbered, [self.key], ["__version"]).drop("__version")

    def _parts(self, before: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """The last full table and the changes since, None where there is none; ``before`` as in ``read``."""
        versions = self.versions()
        tagged = [v[0] for v in versions if before is not None and v[3] == before]
        if tagged:
            versions = [v for v in versions if v[0] < tagged[0]]
        fulls = [v for v in versions if v[1] == "full"]
        changes = [v[4] for v in versions if v[1] == "changes" and (not fulls or v[0] > fulls[-1][0])]
        base = self._load_full(fulls[-1][4], fulls[-1][2]) if fulls else None
        return base, self._load_changes(changes) if changes else None

    def _overlaid(self, base: DataFrame | None, overlay: DataFrame | None, full: DataFrame | None) -> DataFrame:
        if base is None and overlay is None:
            return self.spark.createDataFrame([], self.schema)
        if base is None or overlay is None:
            return base if overlay is None else overlay
        kept = base.join(full.select(self.key), self.key, "left_anti").select(base.columns)
        return kept.unionByName(overlay)

    def read(self, before: str | None = None) -> DataFrame:
        """The current table; empty with the fixed schema when nothing was written.

        ``before`` names a tag: the table as it was before that write, or as it is
        if the write has not happened yet.
        """
        base, overlay = self._parts(before)
        return self._overlaid(base, overlay, overlay)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Stored rows of the given keys.

        The semi join happens below the overlay: few keys are broadcast by
        their measured size, many are shuffled to the table's buckets, and the
        table itself stays in place.  What a run joins afterwards is no larger
        than the rows it touches.
        """
        wanted = keys.select(self.key)
        base, overlay = self._parts()
        return self._overlaid(
            None if base is None else base.join(wanted, self.key, "left_semi"),
            None if overlay is None else overlay.join(wanted, self.key, "left_semi"),
            overlay,
        )

    def _folder(self, kind: str, tag: str | None = None, buckets: int | None = None) -> tuple[int, int, str]:
        """Number, buckets (as before unless given) and folder of the next version."""
        versions = self.versions()
        number = versions[-1][0] + 1 if versions else 1
        buckets = buckets or (versions[-1][2] if versions else self.buckets)
        name = f"v{number:08d}-{kind}-b{buckets}" + (f"-t{tag}" if tag else "")
        return number, buckets, f"{self.path}/{name}"

    def write_full(self, df: DataFrame, by_bucket: bool = False, buckets: int | None = None) -> int:
        """Write the whole table as the next version, in buckets by key."""
        number, buckets, folder = self._folder("full", buckets=buckets)
        rows = df.select(*self.columns)
        if not by_bucket:
            rows = rows.repartition(buckets, self.key)
        (
            rows.write.mode("overwrite")
            .bucketBy(buckets, self.key)
            .sortBy(self.key)
            .option("path", folder)
            .saveAsTable(self._name(folder))
        )
        return number

    def append_changes(self, df: DataFrame, tag: str | None = None) -> int | None:
        """Write the changed rows as the next version.

        A tag makes the write idempotent: a tag already committed is not
        written again (a replayed micro-batch).
        """
        if tag and any(v[3] == tag for v in self.versions()):
            return None
        number, _, folder = self._folder("changes", tag)
        df.select(*self.columns).write.mode("overwrite").parquet(folder)
        last_full = max([v[0] for v in self.versions() if v[1] == "full"], default=0)
        if self.compact_after and number - last_full >= self.compact_after:
            number = self.compact()
        return number

    def compact(self, buckets: int | None = None) -> int:
        """Fold all change sets into a new full table.

        The full table is read by bucket and the changes are dealt by bucket, so
        its rows are written without a shuffle and a bucket gets two files at
        most.  Another number of ``buckets`` shuffles the whole table once.
        """
        base, overlay = self._parts()
        held = self.versions()[-1][2] if base is not None else None
        aligned = held is not None and buckets in (None, held)
        if aligned and overlay is not None:
            overlay = overlay.repartition(held, self.key)
        return self.write_full(self._overlaid(base, overlay, overlay), by_bucket=aligned, buckets=buckets)

    def expire(self, keep: int = 2, min_age: float = 3600.0) -> list[int]:
        """Remove versions that no read needs any more; returns their numbers.

        The last ``keep`` full tables stay, with all changes since the oldest of
        them.  So does what was written less than ``min_age`` seconds ago, for a
        reader that still has it in its plan.  Tags of removed versions are
        forgotten: call this for batches that can no longer be replayed.
        """
        if keep < 1:
            raise ValueError("at least one full version must stay")
        versions = self.versions()
        fulls = [v[0] for v in versions if v[1] == "full"]
        if len(fulls) <= keep:
            return []
        jvm = self.spark.sparkContext._jvm
        removed = []
        for number, kind, _, _, folder in versions:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            written = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")).getModificationTime() / 1000
            if number >= fulls[-keep] or time.time() - written < min_age:
                continue
            # without its mark a version counts no more, so a broken removal leaves no half version
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS"), False)
            if kind == "full":
                self.spark.sql(f"DROP TABLE IF EXISTS `{self._name(folder)}`")
            fs.delete(path, True)
            removed.append(number)
        return removed

    def count(self) -> int:
        return self.read().count()
