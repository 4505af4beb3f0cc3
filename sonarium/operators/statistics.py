"""Statistics: gauges, histograms of counts, series by day and month, changes from day to day, and pages made of them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts from here on share a bucket.
MOST = 10


def gauges(tables: Iterable[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """name and value of aggregates; those of one table share a scan. A null value, as of an empty sum, is 0."""
    out = None
    for df, measures in tables:
        row = df.agg(*[F.coalesce(m, F.lit(0)).cast("long").alias(n) for n, m in measures.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in measures])
        long = row.select(F.explode(pairs).alias("p")).select("p.name", "p.value")
        out = long if out is None else out.unionByName(long)
    return out


def counts_of(rows: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """key and n, the rows of each key; with a table of keys those without rows too."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    if keys is None:
        return counted
    return keys.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def histogram(counts: DataFrame, most: int = MOST) -> DataFrame:
    """bucket (0 to `most`, which stands for all above) and n, the keys with so many rows; every bucket is there."""
    held = counts.groupBy(F.least("n", F.lit(most)).cast("int").alias("bucket")).agg(F.count("*").alias("keys"))
    every = counts.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(held, "bucket", "left").select("bucket", F.coalesce("keys", F.lit(0)).alias("keys"))


def items_by_tracks(links: DataFrame, item: str) -> DataFrame:
    """How many items have how many enabled links."""
    return histogram(counts_of(links.where(~F.col("disabled")), item))


def tracks_by_items(tracks: DataFrame, links: DataFrame, track: str) -> DataFrame:
    """How many tracks have how many enabled links, those without any too."""
    return histogram(counts_of(links.where(~F.col("disabled")), track, tracks))


def window(first: date | None = None, last: date | None = None, days: int | None = None, today: date | None = None) -> tuple[date | None, date | None]:
    """The first and last day of a request: given ones, or the last `days` days before today, which is left out."""
    if days is not None:
        end = (today or date.today()) - timedelta(days=1)
        return end - timedelta(days=days - 1), end
    return first, last


def daily(stats: DataFrame, first: date | None = None, last: date | None = None, applications: list | None = None) -> DataFrame:
    """date, hits, misses and total of hourly counts (date, application, hits, misses), within days and applications."""
    rows = stats if applications is None else stats.where(F.col("application").isin(applications))
    for bound, holds in ((first, F.col("date") >= F.lit(first)), (last, F.col("date") <= F.lit(last))):
        rows = rows if bound is None else rows.where(holds)
    return rows.groupBy("date").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum(F.col("hits") + F.col("misses")).alias("total"))


def monthly(rows: DataFrame, day: str, *totals: Column) -> DataFrame:
    """month and aggregates, the newest month first."""
    return rows.groupBy(F.trunc(day, "MM").alias("month")).agg(*totals).orderBy(F.desc("month"))


def applications_of_month(stats: DataFrame, applications: DataFrame, month: date) -> DataFrame:
    """application, name, hits, misses, total and ratio (percent, two decimals) in a month, the largest total first; applications (application, name)."""
    rows = stats.where(F.trunc("date", "MM") == F.trunc(F.lit(month), "MM"))
    sums = rows.groupBy("application").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    total = F.col("hits") + F.col("misses")
    ratio = F.when(total > 0, F.round(100.0 * F.col("hits") / total, 2))
    held = sums.join(applications.select("application", "name"), "application")
    return held.select("application", "name", "hits", "misses", total.alias("total"), ratio.alias("ratio")).orderBy(F.desc("total"), "application")


def metadata_of_track(links: DataFrame, metadata: DataFrame) -> DataFrame:
    """track, artist, album, submission_count and created (the earliest), by created, of links (meta_id, submission_count, created)."""
    held = links.join(metadata.select(F.col("id").alias("meta_id"), "track", "artist", "album"), "meta_id")
    return held.groupBy("track", "artist", "album").agg(F.sum("submission_count").alias("submission_count"), F.min("created").alias("created")).orderBy("created", "track", "artist", "album")


def count_and_sum(rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def extremes(rows: DataFrame, column: str) -> DataFrame:
    """low (null for no rows) and high (0 for none)."""
    return rows.agg(F.min(column).alias("low"), F.coalesce(F.max(column), F.lit(0)).alias("high"))


def distinct_sources(rows: DataFrame, link: str, source: str) -> DataFrame:
    """link and how many sources stand behind it, however often each."""
    return rows.groupBy(link).agg(F.count_distinct(source).alias("sources"))


def shares(counts: DataFrame, bucket: str = "bucket", n: str = "n", left_out: object = 0) -> DataFrame:
    """bucket, n and percent as text of two decimals of all but one bucket, which is left out of the whole; 0.00 where there is nothing."""
    kept = counts.where(F.col(bucket) != F.lit(left_out))
    whole = kept.agg(F.sum(n).cast("double").alias("whole"))  # one row
    percent = F.when(F.col("whole") > 0, 100.0 * F.col(n) / F.col("whole")).otherwise(0.0)
    return kept.join(F.broadcast(whole)).select(bucket, n, F.format_string("%.2f", percent).alias("percent"))


def snapshot(stats: DataFrame) -> DataFrame:
    """name and value of the newest date of a table (name, date, value)."""
    newest = stats.agg(F.max("date").alias("date"))  # one row
    return stats.join(F.broadcast(newest), "date").select("name", "value")


def changes_by_day(stats: DataFrame, names: list[str] | None = None, since: date | None = None) -> DataFrame:
    """name, date and change against the date before, of a table (name, date, value).

    Names and dates are chosen before that, so the first date has no change of its own, and is left out."""
    rows = stats if names is None else stats.where(F.col("name").isin(names))
    rows = rows if since is None else rows.where(F.col("date") >= F.lit(since))
    before = F.lag("value", 1, 0).over(Window.partitionBy("name").orderBy("date"))
    first = rows.agg(F.min("date").alias("first"))  # one row
    return rows.withColumn("change", F.col("value") - before).join(F.broadcast(first)).where("date > first").select("name", "date", "change")


def pivoted(changes: DataFrame, names: list[str]) -> DataFrame:
    """date and a column for each name; the names are given, so no job is needed to find them. 0 where a name has no value on a date."""
    return changes.groupBy("date").pivot("name", names).agg(F.first("change")).na.fill(0, names)


def with_and_without(gauge: DataFrame, every: str = "track.all", without: str = "track.0mbids") -> DataFrame:
    """everything, some (all but those without) and percent, out of gauges (name, value)."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0)).cast("long")
    row = gauge.agg(of(every).alias("everything"), of(without).alias("without"))
    some = F.col("everything") - F.col("without")
    percent = F.when(F.col("everything") > 0, 100.0 * some / F.col("everything")).otherwise(0.0)
    return row.select("everything", some.alias("some"), F.format_string("%.2f", percent).alias("percent"))


def distribution(gauge: DataFrame, suffix: str) -> DataFrame:
    """bucket, n and percent of gauges called like track.3mbids, from 1 on."""
    bucket = F.nullif(F.regexp_extract("name", rf"^[a-z]+\.(\d+){suffix}$", 1), F.lit("")).cast("int")
    return shares(gauge.select(bucket.alias("bucket"), F.col("value").alias("n")).where("bucket is not null"))


def top_per_group(rows: DataFrame, group: str, most: int, *order: Column | str) -> DataFrame:
    """rows with `place`, the first `most` of each group; Spark drops the others before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """key, first and days of the unbroken runs of days."""
    rows = days.select(key, F.col(day).alias("day")).distinct()
    mark = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return rows.withColumn("mark", mark).groupBy(key, "mark").agg(F.min("day").alias("first"), F.count("*").alias("days")).drop("mark")


def unbroken_months(months: DataFrame, start: date) -> int:
    """How many months are there without a gap, from a start month on (a table of a few months)."""
    held = months.select(F.trunc("month", "MM").alias("month")).distinct().where(F.col("month") >= F.trunc(F.lit(start), "MM"))
    numbered = held.withColumn("n", F.row_number().over(Window.orderBy("month")))
    return numbered.where(F.add_months(F.trunc(F.lit(start), "MM"), F.col("n") - 1) == F.col("month")).count()


def months_between(rows: DataFrame, day: str, today: Column | None = None) -> DataFrame:
    """Every month from the first day's to today's, or to the last day's."""
    ends = rows.agg(F.trunc(F.min(day), "MM").alias("a"), F.trunc(F.max(day) if today is None else today, "MM").alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def backfilled(rows: DataFrame, links: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """rows (key, created) whose null times are the earliest of their links (key, created), for keys within a range: above first, up to last."""
    earliest = links.where((F.col(key) > first) & (F.col(key) <= last)).groupBy(key).agg(F.min("created").alias("earliest"))
    return rows.join(earliest, key, "left").withColumn("created", F.coalesce("created", "earliest")).drop("earliest")
