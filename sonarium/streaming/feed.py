"""The change feed: capture of inserts, pages after a cursor, its floor, bootstrap, latest changes, and hourly counters as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.operators.lookup import page
from sonarium.operators.state import numbered

LARGEST_PAGE, CHUNK = 100_000, 10_000
#: Milliseconds that a reader is told to wait: after a full page, and after one that was not.
BUSY_WAIT, IDLE_WAIT = 0, 1000
#: The only lineage there is, and the place in the index feed where its index was made.
GENERATION, INDEX = 1, "main"


class Gone(Exception):
    """The cursor lies before what the feed still keeps."""


class UnknownLineage(Exception):
    """The reader follows another index, or another generation of it."""


def check_lineage(index: str, generation: int) -> None:
    if (index, generation) != (INDEX, GENERATION):
        raise UnknownLineage(f"{index}/{generation}")


def captured(log: DataFrame, inserted: DataFrame) -> DataFrame:
    """The log (id, fingerprint_id, query) with a row for each inserted fingerprint (id, hashes).

    Positions continue from the log's last one, without gaps, in the order of the ids, which is that of the inserts."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).scalar()
    new = numbered(inserted.select(F.col("id").alias("fingerprint_id"), fp.extract_query(F.col("hashes")).alias("query")), ["fingerprint_id"])
    return log.unionByName(new.select((F.col("n") + F.lit(top)).alias("id"), "fingerprint_id", "query"))


def read_changes(log: DataFrame, after: int, most: int, floor: int | None = None) -> DataFrame:
    """The next changes by id, `most` of them, within 0 and LARGEST_PAGE. A cursor before the floor would miss some silently, so it fails."""
    if floor is not None and after < floor:
        raise Gone(f"changes up to {floor} are gone; start again from a bootstrap")
    return page(log, "id", after, max(0, min(most, LARGEST_PAGE)))


@dataclass(frozen=True)
class Page:
    """Changes as (position, fingerprint id, unsigned terms), and how long to wait for more."""

    entries: list[tuple[int, int, list[int]]]
    retry_after_ms: int


def read_page(log: DataFrame, after: int, most: int = LARGEST_PAGE, floor: int | None = None, index: str = INDEX, generation: int = GENERATION) -> Page:
    """One answer of the feed, of bounded size, on the driver."""
    check_lineage(index, generation)
    rows = read_changes(log, after, most, floor).select("id", "fingerprint_id", fp.to_unsigned(F.col("query")).alias("query")).collect()
    full = bool(rows) and len(rows) == max(0, min(most, LARGEST_PAGE))
    return Page([(r.id, r.fingerprint_id, r["query"]) for r in rows], BUSY_WAIT if full else IDLE_WAIT)


def index_feed(after: int, most: int) -> list[tuple[int, str, str]]:
    """Position, kind and name of changes to the set of indexes: the one index was made once, and stays."""
    return [op for op in [(GENERATION, "create", INDEX)] if op[0] > after][:most]


def latest(log: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The last change of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("r")).select(key, "r.*")


def bootstrap(snapshot: DataFrame, log: DataFrame, key: str, position: int) -> DataFrame:
    """A snapshot, brought up to date by the changes after the position that was read before it."""
    changes = latest(log.where(F.col("id") > position), key)
    return snapshot.join(changes.select(key), key, "left_anti").unionByName(changes.select(snapshot.columns))


def bootstrap_rows(corpus: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, id and terms of all fingerprints (id, hashes) that have any: what a stream of chunks carries, made in parallel."""
    # A filter on a generated column stays above its generator, so the terms are made once.
    rows = corpus.select("id", F.explode(F.array(fp.extract_query(F.col("hashes")))).alias("terms")).where(F.size("terms") > 0)
    return rows.select(F.floor(F.col("id") / chunk).alias("chunk"), "id", "terms")


def bootstrap_stream(corpus: DataFrame, position: int, chunk: int = CHUNK) -> Iterator[object]:
    """What one reader gets, in order: the position, lists of (id, terms), one for each page of ids, and an empty list at the end.

    Pages follow each other by id. Fingerprints without terms, and pages of such alone, are left out, so an empty
    list stands at the end only. A page is held on the driver at a time."""
    yield position
    after, size = 0, max(1, min(chunk, LARGEST_PAGE))
    while rows := page(corpus, "id", after, size).select("id", fp.extract_query(F.col("hashes")).alias("terms")).collect():
        after = rows[-1].id
        if some := [(r.id, r.terms) for r in rows if r.terms]:
            yield some
    yield []


def hourly_counts(spark: SparkSession, events_dir: str, files: str, out: str, checkpoint: str, late: str = "1 hour") -> None:
    """Drains event files into hourly counts by type, as a stream that ends when all are read.

    Each batch writes the counts of the hours that it touched, so that a table of them is brought up to date by
    the newest row of an hour and type (see newest_counts()). Hours that lie too far back are forgotten by the state."""
    schema = spark.read.parquet(f"{events_dir}/{files}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(events_dir)
    counts = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))

    def store(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.col("w.start").alias("hour"), "event_type", "n")
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a batch that is run again replaces itself

    counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_counts(spark: SparkSession, out: str) -> DataFrame:
    """hour, event_type and n after the last batch that touched them."""
    return spark.read.parquet(out).groupBy("hour", "event_type").agg(F.max_by("n", "epoch").alias("n"))


class Pace:
    """The wait between two polls, in seconds: longer by a factor when there was nothing, shorter when there was, within bounds."""

    def __init__(self, least: float = 1.0, most: float = 10.0, factor: float = 1.3, reset: bool = False):
        self.least, self.most, self.factor, self.reset, self.wait = least, most, factor, reset, least

    def next(self, found: bool) -> float:
        if found:
            self.wait = self.least if self.reset else max(self.least, self.wait / self.factor)
        else:
            self.wait = min(self.most, self.wait * self.factor)
        return self.wait


#: What runs when, for an outside scheduler (minute hour day month weekday).
SCHEDULE = {"lookup statistics": "* * * * *", "user agent statistics": "0 * * * *", "daily statistics": "10 0 * * *", "changelog partitions": "0 * * * *"}
