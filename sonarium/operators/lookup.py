"""Lookups: single rows, many keys, pages, ranges, links by item, redirects, and what is missing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a range scan that are left for later runs, as rows may still arrive among them.
TAIL = 1000


class NotOne(ValueError):
    """More than one row has a key that should be unique."""


def same(values: dict[str, object]) -> Column:
    """Rows whose columns have these values; None stands for null, and meets null."""
    held = F.lit(True)
    for name, value in values.items():
        held = held & F.col(name).eqNullSafe(F.lit(value))
    return held


def find(df: DataFrame, **values: object) -> DataFrame:
    """The rows with these values. The filter reaches the scan, so that files without the key are not read."""
    return df.where(same(values))


def find_same_name(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows whose text is the name, in whatever case."""
    return df.where(F.lower(column) == name.lower())


def one_or_none(df: DataFrame, **values: object):
    """The only row with these values, or None; NotOne where there are several. Two rows at most come to the driver."""
    rows = find(df, **values).limit(2).collect()
    if len(rows) > 1:
        raise NotOne(f"several rows have {values}")
    return rows[0] if rows else None


def scalar(df: DataFrame, column: str, **values: object):
    """One column of the only row with these values, or None."""
    row = one_or_none(df.select(column, *[c for c in values if c != column]), **values)
    return None if row is None else row[column]


def multi_get(df: DataFrame, key: str, ids: DataFrame | list) -> DataFrame:
    """The rows with one of the ids. A list becomes a filter, which the scan takes; a table is joined, and how is left to its size."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def page(df: DataFrame, key: str, after: int, size: int, inclusive: bool = False) -> DataFrame:
    """The next rows after a key, or from it on, by key."""
    begin = F.col(key) >= after if inclusive else F.col(key) > after
    return df.where(begin).orderBy(key).limit(size)


def in_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows from low, up to but without high."""
    return df.where((F.col(key) >= low) & (F.col(key) < high))


def ranges(done: int, newest: int, size: int = 10_000, tail: int = TAIL) -> Iterator[tuple[int, int]]:
    """Ranges of ids from `done` on, the last of which ends `tail` ids before the newest."""
    end = newest - tail
    for low in range(done, end, size):
        yield low, min(low + size, end)


def chunks(df: DataFrame, key: str, size: int = 10_000, tail: int = TAIL) -> Iterator[DataFrame]:
    """The table in ranges of its ids, without the newest ones. Only the two extremes come to the driver."""
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if ends.low is not None:
        for low, high in ranges(ends.low, ends.high, size, tail):
            yield in_range(df, key, low, high)


def present(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key another table has, each once, however often it has it."""
    return rows.join(ids.select(key), key, "left_semi")


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The distinct keys that were expected and not found."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def redirected(rows: DataFrame, redirects: DataFrame, key: str, to: str = "target") -> DataFrame:
    """rows with `to`: where a redirect (key, new) leads, or the key itself. One hop only."""
    hop = redirects.select(key, F.col("new").alias(to))
    return rows.join(hop, key, "left").withColumn(to, F.coalesce(to, key))


def links_of(links: DataFrame, tracks: DataFrame, items: DataFrame | list, item: str, disabled: bool = True) -> DataFrame:
    """item, track_id, gid, submission_count and disabled of the links to some items; without the disabled ones if not asked for."""
    chosen = multi_get(links if disabled else links.where(~F.col("disabled")), item, items)
    return chosen.join(tracks.select(F.col("id").alias("track_id"), "gid"), "track_id").select(item, "track_id", "gid", "submission_count", "disabled")


def listed_by_item(items: DataFrame, links: DataFrame, tracks: DataFrame, item: str, disabled: bool = False) -> DataFrame:
    """For each item asked for, its tracks' gids, by track; an empty list where it has none."""
    found = links_of(links, tracks, items, item, disabled).groupBy(item).agg(F.array_sort(F.collect_list(F.struct("track_id", "gid"))).alias("t"))
    held = items.select(item).distinct().join(found, item, "left")
    return held.select(item, F.coalesce(F.transform("t", lambda t: t["gid"]), F.array().cast("array<string>")).alias("tracks"))


def with_foreign_id(rows: DataFrame, vendors: DataFrame, vendor: str, name: str) -> DataFrame:
    """rows with foreign_id, vendor:name. vendors: vendor (id), vendor_name."""
    return rows.join(vendors.select(F.col("vendor").alias(vendor), "vendor_name"), vendor).withColumn("foreign_id", F.concat_ws(":", "vendor_name", name)).drop("vendor_name")


def summaries(recordings: DataFrame, credits: DataFrame) -> DataFrame:
    """gid, title, artist and seconds of recordings (gid, name, artist_credit, length); a null length is 0."""
    held = recordings.join(credits.select(F.col("id").alias("artist_credit"), F.col("name").alias("artist")), "artist_credit")
    return held.select("gid", F.col("name").alias("title"), "artist", (F.coalesce("length", F.lit(0)) / 1000.0).alias("seconds"))


def recording_page(recordings: DataFrame, credits: DataFrame, links: DataFrame, tracks: DataFrame, item: str = "mbid") -> DataFrame:
    """Recordings (see summaries(); links name them by item) with title, artist, seconds, and the gids of their tracks, those of disabled links too."""
    named = summaries(recordings, credits).withColumnRenamed("gid", item)
    return named.join(listed_by_item(named.select(item), links, tracks, item, disabled=True), item)


def name_or_key(name: str, key: str) -> Column:
    """What rows are sorted by: the name, or of those without one the key."""
    return F.coalesce(F.nullif(name, F.lit("")), F.col(key).cast("string"))


def by_name(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Sorted by name, rows without one by their key."""
    return rows.orderBy(name_or_key(name, key))


def last_by(rows: DataFrame, *order: str) -> DataFrame:
    """The one row that comes last in an order, found without a sort of all rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.max_by(whole, F.struct(*order)).alias("r")).where("r is not null").select("r.*")


def with_tracks(fingerprints: DataFrame, tracks: DataFrame) -> DataFrame:
    """Fingerprints (track_id) with what is known of their track (tracks: id and other columns); those of no track are left out."""
    return fingerprints.join(tracks.withColumnRenamed("id", "track_id"), "track_id")


def placements(tracks: DataFrame, mediums: DataFrame, releases: DataFrame, events: DataFrame) -> DataFrame:
    """Where recordings stand: tracks (medium) with their medium (mediums: id, release) and release (releases: id, place), and with an event of the release's place, if any (events: place)."""
    placed = tracks.join(mediums.withColumnRenamed("id", "medium"), "medium").join(releases.withColumnRenamed("id", "release"), "release")
    return placed.join(events, "place", "left")


def with_names(rows: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """Rows with what tables say of their keys, one table after another; a key that a table lacks, or that is null, leaves nulls."""
    for key, names in steps:
        rows = rows.join(names, key, "left")
    return rows


def matched(links: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """All links, with each recording of their key, if there is any."""
    return links.join(recordings, key, "left")


def public(rows: DataFrame, id_column: str, milliseconds: str, **names: str) -> DataFrame:
    """Rows as they are shown: the id as text, a length in seconds, and other columns under new names."""
    return rows.select(F.col(id_column).cast("string").alias("id"), (F.col(milliseconds) / 1000.0).alias("share"), *[F.col(v).alias(k) for k, v in names.items()])
