"""The change log in storage, and as a source of streams.

A log is a folder: its rows (id, fingerprint_id, query, created) lie by month, each batch of inserts in a folder of its own; a head,
written last, says that a batch counts, and which positions it has. Positions ascend with the inserts, without gaps.
Months are made ahead and dropped as they age. Before rows go, the floor is raised to their last position, so that whoever is behind
fails instead of missing some. Readers open the months alone that they need.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sonarium.operators.state import partitions
from sonarium.sources.tables import Scratch, delete, shared_folder
from sonarium.streaming.feed import LARGEST_PAGE, Gone, captured

ROW = "id BIGINT, fingerprint_id BIGINT, query ARRAY<BIGINT>, created TIMESTAMP"


@dataclass(frozen=True)
class Head:
    """A batch that counts: its positions from first to last, its month, and its folder's name."""

    first: int
    last: int
    month: str
    batch: str


def _heads(names: list[str]) -> list[Head]:
    """Heads say all by their names: first-last-month-batch."""
    parts = [n.split("_") for n in sorted(names)]
    return [Head(int(p[0]), int(p[1]), p[2], p[3]) for p in parts]


def _checked(after: int, floor: int) -> None:
    if after < floor:
        raise Gone(f"changes up to {floor} are gone; start again from a bootstrap")


class ChangeLog:
    """A log in a folder of the shared storage. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "log")

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.folder, name))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, name: str) -> list[str]:
        path, files = self._files(name)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _mark(self, name: str) -> None:
        path, files = self._files(name)
        files.create(path, False).close()

    def heads(self) -> list[Head]:
        return _heads([n for n in self._names("heads") if not n.startswith(".")])

    def floor(self) -> int:
        """The last position that is gone."""
        return max((int(n) for n in self._names("floors") if n.isdigit()), default=0)

    def last(self) -> int:
        return max([h.last for h in self.heads()] + [self.floor()])

    def append(self, inserted: DataFrame, day: date) -> Head | None:
        """Adds a change for each inserted fingerprint (id, hashes), on a day."""
        top, month, batch = self.last(), day.replace(day=1).isoformat(), uuid.uuid4().hex
        log = self.spark.createDataFrame([(top, None, None)], "id long, fingerprint_id long, query array<long>")
        with Scratch(self.spark) as scratch:
            held = scratch.keep(inserted.select("id", "hashes"), "inserted")
            new = captured(log, held).where(F.col("id") > top).withColumn("created", F.lit(day).cast("timestamp"))
            path = f"{self.folder}/changes/month={month}/batch={batch}"
            new.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
            n = held.count()
        if not n:
            return None
        self._mark(f"heads/{top + 1:020d}_{top + n:020d}_{month}_{batch}")
        return self.heads()[-1]

    def rows(self, after: int = 0) -> DataFrame:
        """All changes after a position, from the months alone that have any."""
        _checked(after, self.floor())
        heads = [h for h in self.heads() if h.last > after]
        if not heads:
            return self.spark.createDataFrame([], ROW)
        rows = self.spark.read.schema(f"{ROW}, month DATE, batch STRING").parquet(f"{self.folder}/changes")
        months = [F.lit(m).cast("date") for m in sorted({h.month for h in heads})]
        rows = rows.where(F.col("month").isin(months) & F.col("batch").isin([h.batch for h in heads]))
        return rows.where(F.col("id") > after).drop("month", "batch")

    def page(self, after: int, most: int) -> DataFrame:
        """The next changes by position, `most` of them; as positions have no gaps, a page is a range of them."""
        most = max(0, min(most, LARGEST_PAGE))
        return self.rows(after).where(F.col("id") <= after + most)

    def months(self) -> list[str]:
        return sorted(n.removeprefix("month=") for n in self._names("changes") if n.startswith("month="))

    def maintain(self, today: date) -> dict[str, list[str]]:
        """Makes the months to come, and drops those that are too old; see state.partitions(). The floor is raised before rows go."""
        held = self.spark.createDataFrame([(m,) for m in self.months()], "month string").withColumn("month", F.to_date("month"))
        due = {"create": [], "drop": []}
        for row in partitions(held, F.lit(today)).collect():
            due[row.action].append(row.month.isoformat())
        for month in due["create"]:
            path, files = self._files(f"changes/month={month}")
            files.mkdirs(path)
        gone = [h for h in self.heads() if h.month in due["drop"]]
        if gone:
            self._mark(f"floors/{max(h.last for h in gone):020d}")
        for h in gone:
            delete(self.spark, f"{self.folder}/heads/{h.first:020d}_{h.last:020d}_{h.month}_{h.batch}")
        for month in due["drop"]:
            delete(self.spark, f"{self.folder}/changes/month={month}")
        return {k: sorted(v) for k, v in due.items()}


@dataclass
class _Range(InputPartition):
    """Changes after `low` up to `high`, and the folders that have them."""

    low: int
    high: int
    folders: tuple[str, ...]

    def __init__(self, low: int, high: int, folders: tuple[str, ...]):
        super().__init__((low, high))
        self.low, self.high, self.folders = low, high, folders


class ChangeLogReader(DataSourceStreamReader):
    """The offset is the position. A batch is cut into ranges of positions, a task for each; a start below the floor fails."""

    def __init__(self, folder: str, after: int, page: int):
        self.folder, self.after, self.page = folder, after, page

    def _names(self, name: str) -> list[str]:
        files, path = pafs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(pafs.FileSelector(f"{path}/{name}", allow_not_found=True))
        return [f.base_name for f in found if not f.base_name.startswith(".")]

    def _floor(self) -> int:
        return max((int(n) for n in self._names("floors") if n.isdigit()), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"position": max([h.last for h in _heads(self._names("heads"))] + [self._floor(), self.after])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = start["position"], end["position"]
        _checked(low, self._floor())
        heads = _heads(self._names("heads"))
        out = []
        for begin in range(low, high, self.page):
            stop = min(begin + self.page, high)
            out.append(_Range(begin, stop, tuple(f"month={h.month}/batch={h.batch}" for h in heads if h.last > begin and h.first <= stop)))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(self.folder)
        for folder in partition.folders:
            for f in files.get_file_info(pafs.FileSelector(f"{path}/changes/{folder}")):
                if not f.base_name.endswith(".parquet"):
                    continue
                rows = pq.read_table(f.path, filesystem=files, columns=["id", "fingerprint_id", "query"], filters=[("id", ">", partition.low), ("id", "<=", partition.high)])
                for batch in rows.to_batches(max_chunksize=10_000):
                    yield batch


class ChangeLogSource(DataSource):
    """Options: folder, after (the position to start behind, 0 by default), page (positions of a task)."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return "id BIGINT, fingerprint_id BIGINT, query ARRAY<BIGINT>"

    def streamReader(self, schema) -> ChangeLogReader:  # noqa: N802, ARG002
        return ChangeLogReader(self.options["folder"], int(self.options.get("after", "0")), int(self.options.get("page", str(LARGEST_PAGE))))


def changes_stream(spark: SparkSession, folder: str, after: int = 0, page: int = LARGEST_PAGE) -> DataFrame:
    """A stream of the log's changes behind a position."""
    spark.dataSource.register(ChangeLogSource)
    return spark.readStream.format("change_log").option("folder", folder).option("after", str(after)).option("page", str(page)).load()


#: Parts that kept messages lie in, by a hash of their subject.
SUBJECT_PARTS = 64


def keep_messages(spark: SparkSession, batch: DataFrame, folder: str) -> None:
    """A sink that keeps the newest message (subject, lsn, body) of each subject. Only the parts that a batch touches are read and written; a batch that comes again changes nothing."""
    part = F.pmod(F.xxhash64("subject"), F.lit(SUBJECT_PARTS)).cast("int")
    newest = lambda rows: rows.groupBy("subject").agg(F.max_by(F.struct("lsn", "body"), "lsn").alias("m")).select("subject", "m.*")
    with Scratch(spark) as scratch:
        new = scratch.keep(newest(batch), "messages")
        parts = [r[0] for r in new.select(part).distinct().collect()]
        held = kept_messages(spark, folder, parts)
        rows = scratch.keep(newest(new if held is None else held.unionByName(new)), "messages").withColumn("part", part)
        rows.repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def kept_messages(spark: SparkSession, folder: str, parts: list[int] | None = None) -> DataFrame | None:
    """The messages that keep_messages() has kept; None before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    rows = spark.read.schema("subject STRING, lsn DECIMAL(20,0), body STRING, part INT").parquet(folder)
    return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")
