"""Links between tracks and items: counted upserts with their provenance, merges of items and of tracks, and switches with an audit.

Links have id, track_id, an item's column, submission_count and, for catalogue ids, disabled and merged_into.
Every change is a function from tables to new tables; what a change did to ids comes as a table too, by which
provenance and audit rows follow.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.operators.state import closure, numbered


class AlreadyMerged(ValueError):
    """A link is merged into another one than the one asked for."""


@dataclass(frozen=True)
class LinkChanges:
    """Links with new counts, new links, and a provenance row (link_id, submission_id, source_id) for each event."""

    counted: DataFrame
    added: DataFrame
    provenance: DataFrame


def link_changes(links: DataFrame, events: DataFrame, item: str, top: int | None = None) -> LinkChanges:
    """What events (track_id, item, submission_id, source_id) change about links. top: the largest id, if known.

    A link that is there gains one for each event; a new one begins with their number, and gets the next id."""
    keys = ["track_id", item]
    gained = events.groupBy(*keys).agg(F.count("*").alias("gained"))
    counted = links.join(gained, keys).withColumn("submission_count", (F.col("submission_count") + F.col("gained")).cast("long")).select(links.columns)
    if top is None:
        top = links.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).first()[0]
    new = numbered(gained.join(links.select(keys), keys, "left_anti"), keys).withColumn("id", F.col("n") + F.lit(top))
    rest = {"submission_count": F.col("gained"), "disabled": F.lit(False)}
    added = new.select(*[(rest[c] if c in rest else F.col(c) if c in ("id", *keys) else F.lit(None)).cast(links.schema[c].dataType).alias(c) for c in links.columns])
    ids = counted.unionByName(added).select(F.col("id").alias("link_id"), *keys)
    return LinkChanges(counted, added, events.join(ids, keys).select("link_id", "submission_id", "source_id"))


def upserted(links: DataFrame, events: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """The links after events, and the provenance rows of these; see link_changes()."""
    made = link_changes(links, events, item)
    return links.join(made.counted.select("id"), "id", "left_anti").select(links.columns).unionByName(made.counted).unionByName(made.added), made.provenance


def followed(rows: DataFrame, moved: DataFrame, column: str = "link_id") -> DataFrame:
    """Provenance or audit rows whose links moved (id, target)."""
    to = moved.select(F.col("id").alias(column), F.col("target").alias("target_"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("target_", column)).select(rows.columns)


def merged_item(links: DataFrame, source: object, target: object, item: str) -> tuple[DataFrame, DataFrame]:
    """Links of one item handed to another on every track that has them, and where their provenance moves (id, target).

    The source's link is emptied, disabled, and points to the target's; the target's gains its count, and is
    disabled only if both were. Where a track lacks the target, an enabled one is made. AlreadyMerged, before
    anything happens, if a source points elsewhere."""
    side = lambda value: F.first(F.when(F.col(item) == F.lit(value), F.struct("id", "submission_count", "disabled", "merged_into")), ignorenulls=True)
    both = links.where(F.col(item).isin(source, target)).groupBy("track_id").agg(side(source).alias("s"), side(target).alias("t")).where("s is not null")
    top = links.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).scalar()
    lacking = numbered(both.where("t is null").select("track_id"), ["track_id"]).select("track_id", (F.col("n") + F.lit(top)).alias("made"))
    plan = both.join(lacking, "track_id", "left").withColumn("target", F.coalesce("t.id", "made"))
    if not plan.where(F.col("s.merged_into").isNotNull() & (F.col("s.merged_into") != F.col("target"))).isEmpty():
        raise AlreadyMerged(f"{source} is already merged into another item")
    gained = (F.coalesce("t.submission_count", F.lit(0)) + F.col("s.submission_count")).alias("submission_count")
    disabled = (F.coalesce("t.disabled", F.lit(False)) & F.col("s.disabled")).alias("disabled")
    emptied = plan.select(F.col("s.id").alias("id"), "track_id", F.lit(source).alias(item), F.lit(0).alias("submission_count"), F.lit(True).alias("disabled"), F.col("target").alias("merged_into"))
    filled = plan.select(F.col("target").alias("id"), "track_id", F.lit(target).alias(item), gained, disabled, F.col("t.merged_into").alias("merged_into"))
    changed = emptied.unionByName(filled).select(*[F.col(c).cast(links.schema[c].dataType).alias(c) for c in links.columns])
    moved = plan.select(F.col("s.id").alias("id"), "target")
    return links.join(changed.select("id"), "id", "left_anti").select(links.columns).unionByName(changed), moved


def merged_links(links: DataFrame, remap: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Links moved with their tracks (track_id, target), and where those that went point now (id, target).

    Of links that become equal the smallest id stays, with the sum of counts, disabled only if all were. Sums are
    made before the shuffle, and no list of ids is held. Links of other tracks are not touched."""
    to = remap.select("track_id", F.col("target").alias("to_"))
    mine = links.join(to, "track_id")
    sums = [F.min("id").alias("id"), F.sum("submission_count").alias("submission_count")]
    sums += [F.bool_and("disabled").alias("disabled")] if "disabled" in links.columns else []
    sums += [F.min_by(c, "id").alias(c) for c in links.columns if c not in ("id", "track_id", item, "submission_count", "disabled")]
    kept = mine.groupBy(F.col("to_").alias("track_id"), item).agg(*sums)
    kept = kept.select(*[F.col(c).cast(links.schema[c].dataType).alias(c) for c in links.columns])
    moved = mine.select("id", F.col("to_").alias("track_id"), item).join(kept.select(F.col("id").alias("target"), "track_id", item), ["track_id", item]).where("id <> target").select("id", "target")
    return links.join(remap.select("track_id"), "track_id", "left_anti").select(links.columns).unionByName(kept), moved


@dataclass(frozen=True)
class TrackTables:
    """All that hangs on tracks: links and their provenance by item column, audit rows of catalogue ids, fingerprints, and the tracks (id, new_id)."""

    links: dict[str, DataFrame]
    provenance: dict[str, DataFrame]
    audit: DataFrame
    fingerprints: DataFrame
    tracks: DataFrame


def merged_tracks(tables: TrackTables, sources: DataFrame, audited: str = "mbid") -> TrackTables:
    """The tables after tracks (track_id, target) were merged: all link tables, with provenance and audit, fingerprints, and redirects.

    Any number of merges happen in one step. A target that is merged itself, now or earlier, stands for where that leads (see
    state.closure()), so links are summed once, where they end up, and every redirect is one hop. Nothing is changed where the
    merges lead in a circle, or send a track to two targets."""
    asked = sources.where("track_id <> target").select(F.col("track_id").alias("id"), "target").distinct()
    earlier = tables.tracks.where("new_id is not null and new_id <> id").select("id", F.col("new_id").alias("target")).distinct()
    led = closure(asked.unionByName(earlier.join(asked.select("id"), "id", "left_anti")))
    moved_tracks = led.join(asked.select("id"), "id", "left_semi").select(F.col("id").alias("track_id"), "target")
    ends = moved_tracks.select(F.col("target").alias("track_id"), "target").distinct()
    remap = moved_tracks.unionByName(ends)
    links, provenance, audit = {}, {}, tables.audit
    for item, rows in tables.links.items():
        links[item], moved = merged_links(rows, remap, item)
        provenance[item] = followed(tables.provenance[item], moved)
        audit = followed(audit, moved) if item == audited else audit
    to = moved_tracks.select("track_id", F.col("target").alias("to_"))
    fingerprints = tables.fingerprints.join(to, "track_id", "left").withColumn("track_id", F.coalesce("to_", "track_id")).select(tables.fingerprints.columns)
    tracks = tables.tracks.join(led.select("id", F.col("target").alias("led_")), "id", "left").withColumn("new_id", F.coalesce("led_", "new_id")).select(tables.tracks.columns)
    return replace(tables, links=links, provenance=provenance, audit=audit, fingerprints=fingerprints, tracks=tracks)


def disabled(links: DataFrame, items: DataFrame, item: str, note: Column | str, account: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links with all those of some items disabled, and an audit row (link_id, disabled, note, account_id) for each, those that were so before too."""
    hit = items.select(item).distinct().withColumn("hit_", F.lit(True))
    after = links.join(hit, item, "left").withColumn("disabled", F.col("disabled") | F.coalesce("hit_", F.lit(False))).select(links.columns)
    audit = links.join(hit, item, "left_semi").select(F.col("id").alias("link_id"), F.lit(True).alias("disabled"), F.lit(note).alias("note"), F.lit(account).cast("long").alias("account_id"))
    return after, audit


def toggled(links: DataFrame, ids: DataFrame, note: str, account: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of which those with some ids are switched over, and an audit row for each."""
    hit = ids.select("id").distinct().withColumn("hit_", F.lit(True))
    after = links.join(hit, "id", "left").withColumn("disabled", F.col("disabled") != F.coalesce("hit_", F.lit(False))).select(links.columns)
    audit = after.join(hit, "id", "left_semi").select(F.col("id").alias("link_id"), "disabled", F.lit(note).alias("note"), F.lit(account).cast("long").alias("account_id"))
    return after, audit


def follow_missing(links: DataFrame, missing: DataFrame, redirects: DataFrame, known: DataFrame, unknown: DataFrame, today: Column, item: str, days: int = 7) -> DataFrame:
    """item, target and outcome of items that the catalogue did not show.

    Redirected ones are to be merged, known ones kept; the others are unknown, since today or since the day that
    `unknown` (item, unknown_since) has, and expired after more than some days, when they are to be disabled."""
    asked = missing.select(item).distinct().join(links.select(item), item, "left_semi")
    held = asked.join(redirects.select(item, "target"), item, "left").join(known.select(item, F.lit(True).alias("known")).distinct(), item, "left").join(unknown.select(item, "unknown_since"), item, "left")
    since = F.coalesce(F.to_date("unknown_since"), F.to_date(today))
    outcome = F.when(F.col("target").isNotNull(), "merged").when(F.col("known"), "kept").when(F.datediff(F.to_date(today), since) > days, "expired").otherwise("unknown")
    return held.select(item, "target", outcome.alias("outcome"), F.when(outcome == "unknown", since).alias("unknown_since"))
