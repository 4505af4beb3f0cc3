"""Documents for lookups: catalogue rows folded into recordings, release groups, releases, mediums and tracks, as a request's words ask for.

Flat rows hold the structs recording, release_group, release, medium and track (see flat()). They are grouped
from the tracks upwards; empty fields are null, and JSON leaves them out. Lists are in the order of their
contents, so equal requests give equal documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by which a document holds ids only.
ONLY_IDS = {"recording": "recordingids", "release_group": "releasegroupids", "release": "releaseids"}
#: Submitted metadata that a track may show.
MOST_METADATA = 10


def release_struct(id: Column, title: Column, artists: Column, events: Column, medium_count: Column, track_count: Column) -> Column:
    """A release: its first event's country and date are its own too."""
    some = F.when(F.size(events) > 0, events)
    first = F.get(some, F.lit(0))
    return F.struct(id.alias("id"), F.coalesce(title, F.lit("")).alias("title"), F.nullif(medium_count, F.lit(0)).alias("medium_count"), F.nullif(track_count, F.lit(0)).alias("track_count"), F.when(F.size(artists) > 0, artists).alias("artists"), some.alias("releaseevents"), first["country"].alias("country"), first["date"].alias("date"))


def date_struct(year: Column, month: Column, day: Column) -> Column:
    """A date as far as it is known; null where nothing is."""
    parts = F.struct(*[F.nullif(c, F.lit(0)).alias(n) for n, c in (("year", year), ("month", month), ("day", day))])
    return F.when(F.greatest(*[F.coalesce(c, F.lit(0)) for c in (year, month, day)]) > 0, parts)


def credits(names: DataFrame, artists: DataFrame) -> DataFrame:
    """artist_credit and artists (id, name, and joinphrase unless empty), by position."""
    held = names.join(artists.select(F.col("id").alias("artist"), F.col("gid").alias("artist_gid")), "artist")
    item = F.struct("position", F.struct(F.col("artist_gid").alias("id"), F.col("name").alias("name"), F.nullif("join_phrase", F.lit("")).alias("joinphrase")).alias("a"))
    return held.groupBy("artist_credit").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"]).alias("artists"))


@dataclass(frozen=True)
class Catalogue:
    """Flat rows, with what many rows share apart. recordings: recording_id and recording; groups: group_id_ and release_group; lines:
    recording_id, group_id_, release, medium and track of each track of a release."""

    recordings: DataFrame
    groups: DataFrame
    lines: DataFrame

    def flat(self) -> DataFrame:
        held = self.lines.join(_few(self.groups), "group_id_", "left")
        return self.recordings.join(held, "recording_id", "left").select("recording", "release_group", "release", "medium", "track")

    @staticmethod
    def of(rows: DataFrame) -> Catalogue:
        """Flat rows taken apart."""
        one = lambda name, key: rows.where(F.col(name).isNotNull()).groupBy(F.col(f"{name}.id").alias(key)).agg(F.first(name).alias(name))
        lines = rows.where("release_group is not null or release is not null or track is not null")
        lines = lines.select(F.col("recording.id").alias("recording_id"), F.col("release_group.id").alias("group_id_"), "release", "medium", "track")
        return Catalogue(one("recording", "recording_id"), one("release_group", "group_id_"), lines)


#: Rows of a table that is sent to all tasks.
FEW = 10_000


def _few(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def flat(tables: dict[str, DataFrame], isrcs: bool = False) -> DataFrame:
    """A row for each track of a release, with the structs recording, release_group, release, medium and track; see catalogue().

    Recordings on no release have one row, with null structs."""
    return catalogue(tables, isrcs).flat()


def catalogue(tables: dict[str, DataFrame], isrcs: bool = False) -> Catalogue:
    """The catalogue that flat rows are made of.

    tables: recording, track, medium, release, release_group, artist_credit_name and artist; optional ones are
    medium_format, primary_type, secondary_type, release_event, country and isrc. What belongs to one release or credit
    is gathered before it is joined, and mediums have their release before tracks, the most numerous, meet them once."""
    c = F.col
    named = credits(tables["artist_credit_name"], tables["artist"])
    none = F.array().cast("array<string>")

    def with_artists(df: DataFrame) -> DataFrame:
        return df.join(named, "artist_credit", "left")

    recording = with_artists(tables["recording"])
    if isrcs:
        codes = tables["isrc"].groupBy(c("recording").alias("id")).agg(F.array_sort(F.collect_set("isrc")).alias("isrcs"))
        recording = recording.join(codes, "id", "left")
    codes = F.when(F.size("isrcs") > 0, c("isrcs")) if isrcs else F.lit(None).cast("array<string>")
    fields = [c("gid").alias("id"), F.coalesce("name", F.lit("")).alias("title"), F.nullif(c("length") / 1000.0, F.lit(0.0)).alias("duration"), F.when(F.size("artists") > 0, c("artists")).alias("artists"), codes.alias("isrcs")]
    recording = recording.select(c("id").alias("recording_id"), F.struct(*fields).alias("recording"))

    kinds = tables.get("secondary_type")
    group = with_artists(tables["release_group"]).withColumn("artists", F.when(F.size("artists") > 0, c("artists")))
    if "primary_type" in tables:
        group = group.join(tables["primary_type"].select(c("id").alias("type"), c("name").alias("type_name")), "type", "left")
    else:
        group = group.withColumn("type_name", c("type").cast("string"))
    if kinds is not None:
        group = group.join(kinds.groupBy(c("release_group").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("kinds")), "id", "left")
    else:
        group = group.withColumn("kinds", none)
    group = group.select(c("id").alias("group_id"), c("gid").alias("group_id_"), F.struct(c("gid").alias("id"), F.coalesce("name", F.lit("")).alias("title"), c("type_name").alias("type"), F.when(F.size("kinds") > 0, c("kinds")).alias("secondarytypes"), "artists").alias("release_group"))

    mediums = tables["medium"].select(c("id").alias("medium_id"), c("release").alias("release_id"), "position", "name", "format", "track_count")
    if "medium_format" in tables:
        mediums = mediums.join(tables["medium_format"].select(c("id").alias("format"), c("name").alias("format_name")), "format", "left")
    else:
        mediums = mediums.withColumn("format_name", c("format").cast("string"))
    sizes = mediums.groupBy("release_id").agg(F.count("*").cast("int").alias("medium_count"), F.sum("track_count").cast("int").alias("all_tracks"))
    release = with_artists(tables["release"]).withColumnRenamed("id", "release_id").join(sizes, "release_id")
    if "release_event" in tables:
        events = tables["release_event"]
        event = F.struct(c("country"), date_struct(c("year"), c("month"), c("day")).alias("date"))
        release = release.join(events.groupBy(c("release").alias("release_id")).agg(F.array_sort(F.collect_list(event)).alias("events")), "release_id", "left")
    else:
        release = release.withColumn("events", F.array().cast("array<struct<country: string, date: struct<year: int, month: int, day: int>>>"))
    release = release.select("release_id", c("release_group").alias("group_id"), release_struct(c("gid"), c("name"), c("artists"), c("events"), c("medium_count"), c("all_tracks")).alias("release"))
    medium = mediums.select("medium_id", "release_id", F.struct("position", "track_count", F.nullif("format_name", F.lit("")).alias("format"), F.nullif("name", F.lit("")).alias("title")).alias("medium"))
    track = with_artists(tables["track"]).select(c("recording").alias("recording_id"), c("medium").alias("medium_id"), F.struct(c("gid").alias("id"), "position", c("name").alias("title"), (c("length") / 1000.0).alias("duration"), "artists").alias("track"))
    release = release.join(_few(group.select("group_id", "group_id_")), "group_id", "left")
    lines = track.join(medium.join(release, "release_id"), "medium_id").select("recording_id", "group_id_", "release", "medium", "track")
    return Catalogue(recording, group.select("group_id_", "release_group"), lines)


def _fields(name: str, words: set[str], rows: DataFrame) -> list[str]:
    """The fields of a struct that a document shows: all, or its id alone; codes only where they are asked for."""
    return ["id"] if ONLY_IDS[name] in words else [f for f in rows.schema[name].dataType.names if f != "isrcs" or f in words]


def _shown(name: str, words: set[str], rows: DataFrame) -> Column:
    return F.struct(*[F.first(F.col(name).getField(f)).alias(f) for f in _fields(name, words, rows)])


def _has(parent: str, name: str, rows: DataFrame) -> bool:
    return name in rows.schema[parent].dataType.names


def _dropped(child: Column, parent: Column, name: str, held: tuple[bool, bool]) -> Column:
    """child without a field that repeats its parent's."""
    return child.withField(name, F.when(~child[name].eqNullSafe(parent[name]), child[name])) if all(held) else child


def _lists(rows: DataFrame, keys: list[str], words: set[str]) -> DataFrame:
    """keys and `releases`, an array of structs: all releases of the rows of a key, with their mediums where tracks are asked for."""
    keyed = [*keys, F.col("release.id").alias("release_id_")]
    some = rows.where("release is not null")
    shown = _shown("release", words, rows).alias("release")
    if "tracks" in words:
        inside = some.groupBy(*keyed, F.col("medium.position").alias("medium_"))
        tracks = F.array_sort(F.collect_list(F.struct(F.col("track.position").alias("position"), F.col("track.id").alias("id"), F.col("track.title").alias("title"), F.col("track.artists").alias("artists"))))
        held = inside.agg(F.first("medium").alias("m"), tracks.alias("tracks"), F.first("release").alias("release"))
        medium = F.struct(F.col("m.position").alias("position"), F.col("m.track_count").alias("track_count"), F.col("m.format").alias("format"), F.col("m.title").alias("title"), "tracks")
        whole = held.groupBy(*keys, "release_id_").agg(shown, F.array_sort(F.collect_list(medium)).alias("mediums"))
        if "compress" in words and "releaseids" not in words:
            same = lambda t: t.withField("artists", F.when(~t["artists"].eqNullSafe(F.col("release.artists")), t["artists"]))
            whole = whole.withColumn("mediums", F.transform("mediums", lambda m: m.withField("tracks", F.transform(m["tracks"], same))))
        whole = whole.withColumn("release", F.col("release").withField("mediums", F.col("mediums")))
    else:
        whole = some.groupBy(*keyed).agg(shown)
    made = F.array_sort(F.collect_list("release"))
    return whole.groupBy(*keys).agg(F.when(F.size(made) > 0, made).alias("releases"))


def releases(rows: DataFrame, keys: list[str], words: set[str]) -> DataFrame:
    """keys and releases, of flat rows with some key columns."""
    return _lists(rows, keys, words)


def release_groups(rows: DataFrame, keys: list[str], words: set[str], groups: DataFrame) -> DataFrame:
    """keys and releasegroups, with their releases where these are asked for; with "compress" releases leave out what repeats their group.

    groups: group_id_ and release_group, which come to what is made of the rows."""
    some = rows.where("group_id_ is not null")
    inner = [*keys, "group_id_"]
    if words & {"releases", "releaseids"}:
        held = _lists(some, inner, words)
    else:
        held = some.select(*inner).distinct()
    fields = _fields("release_group", words, groups)
    if fields == ["id"]:
        held = held.withColumn("g", F.struct(F.col("group_id_").alias("id")))
    else:
        held = held.join(_few(groups), "group_id_").withColumn("g", F.struct(*[F.col("release_group").getField(f).alias(f) for f in fields])).drop("release_group")
    if "releases" in held.columns:
        if "compress" in words:
            both = lambda n: (n in held.schema["releases"].dataType.elementType.names, _has("g", n, held))

            def shorter(r: Column) -> Column:
                return _dropped(_dropped(r, F.col("g"), "artists", both("artists")), F.col("g"), "title", both("title"))

            held = held.withColumn("releases", F.transform("releases", shorter))
        held = held.withColumn("g", F.col("g").withField("releases", F.col("releases")))
    return held.groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("releasegroups"))


def _shorter_tracks(release: Column, title: Column) -> Column:
    track = lambda t: t.withField("title", F.when(~t["title"].eqNullSafe(title), t["title"]))
    return release.withField("mediums", F.transform(release["mediums"], lambda m: m.withField("tracks", F.transform(m["tracks"], track))))


def _below(linked: DataFrame, made: DataFrame | None, key: str, name: str, item: Callable[[Column, Column], Column]) -> DataFrame:
    """key and recordings: an item of each linked recording (h) with what was made of its rows (made: key, recording_id_ and a column of that name), or null.

    Both sides are gathered by the key first, so what was made, which is large, need not be dealt out again to be joined."""
    heads = linked.groupBy(key).agg(F.collect_list(F.struct("recording_id_", "r", "sources", "known")).alias("heads_"))
    if made is None:
        return heads.select(key, F.array_sort(F.transform("heads_", lambda h: item(h, F.lit(None)))).alias("recordings"))
    held = made.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("recording_id_", name))).alias("made_"))
    both = heads.join(held, key, "left")
    return both.select(key, F.array_sort(F.transform("heads_", lambda h: item(h, F.col("made_")[h["recording_id_"]]))).alias("recordings"))


def recordings(linked: DataFrame, rows: DataFrame, key: str, words: set[str], groups: DataFrame) -> DataFrame:
    """key and recordings, with release groups or releases where they are asked for, and `sources` where the words ask.

    linked: key, recording_id_, r (as shown) and sources of each recording; rows: what they are on, dealt by the key. With "compress", tracks leave out titles
    that repeat their recording's, and groups or releases artists that do. That goes for all release groups of a recording, not for its last one alone."""
    inner = [key, "recording_id_"]
    deep = "tracks" in words and bool(words & {"releases", "releaseids"})
    fields = linked.schema["r"].dataType.names
    made, name = None, None
    if words & {"releasegroups", "releasegroupids"}:
        made, name = release_groups(rows, inner, words, groups), "releasegroups"
    elif words & {"releases", "releaseids"}:
        made, name = _lists(rows, inner, words), "releases"

    def item(h: Column, below: Column) -> Column:
        r = h["r"]
        if name and "compress" in words:
            artists = ("artists" in made.schema[name].dataType.elementType.names, "artists" in fields)

            def shorter(x: Column) -> Column:
                x = _dropped(x, r, "artists", artists)
                if not (deep and "title" in fields):
                    return x
                if name == "releases":
                    return _shorter_tracks(x, r["title"])
                return x.withField("releases", F.transform(x["releases"], lambda y: _shorter_tracks(y, r["title"])))

            below = F.transform(below, shorter)
        out = r.withField(name, below) if name else r
        return out.withField("sources", h["sources"]) if "sources" in words else out

    return _below(linked, made, key, name or "", item)


def second_format(linked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key and recordings of the second format: id, duration, and tracks with their medium and release, by release and position. linked, rows: as for recordings()."""
    release = F.struct(F.col("release.id").alias("id"), F.col("release.title").alias("title"))
    medium = F.struct(F.col("medium.track_count").alias("track_count"), F.col("medium.position").alias("position"), release.alias("release"), F.col("medium.format").alias("format"))
    track = F.struct(F.col("track.title").alias("title"), F.col("track.duration").alias("duration"), F.col("track.artists").alias("artists"), F.col("track.position").alias("position"), medium.alias("medium"))
    item = F.struct(F.col("release.id").alias("a"), F.col("medium.position").alias("b"), F.col("track.position").alias("c"), track.alias("track"))
    tracks = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["track"])
    made = rows.where("track is not null").groupBy(key, "recording_id_").agg(tracks.alias("tracks"))
    whole = lambda below: F.coalesce(below, F.array().cast(made.schema["tracks"].dataType))
    return _below(linked, made, key, "tracks", lambda h, below: F.struct(h["recording_id_"].alias("id"), h["r"]["duration"].alias("duration"), F.when(h["known"], whole(below)).alias("tracks")))


def documents(results: DataFrame, links: DataFrame, rows: DataFrame | Catalogue, words: set[str], key: str = "result_id", submitted: DataFrame | None = None) -> DataFrame:
    """results (key, track_id, query_id) with what the words ask for, as a column of JSON text called document; null where there is nothing.

    A linked recording that the catalogue lacks is shown by its id, and its sources where these are asked for.

    links: track_id, mbid, submission_count, disabled ones left out before; rows: catalogue(), or flat() rows. What is on a release is dealt out by the key
    once, and all lists are made where it then is; recordings and groups come to what is made. Which kind of document
    it is follows from the words: the second format before recordings, these before release groups, these before
    releases. With "usermeta", the queries of which no result is in the catalogue show submitted metadata
    (submitted: track_id, meta_id, submission_count, title, artist, album), each track's most frequent ones."""
    held = results.select(key, "track_id").join(links.select("track_id", F.col("mbid").alias("recording_id_"), F.col("submission_count").alias("sources")), "track_id")
    of = Catalogue.of(rows) if isinstance(rows, DataFrame) else rows
    known = held.join(of.recordings.withColumn("recording_id_", F.col("recording.id")), "recording_id_", "left")
    # A recording that the catalogue lacks is its id alone.
    fields = ["id", "duration"] if "m2" in words else _fields("recording", words, known)
    shown = [F.first(F.col("recording").getField(f)).alias(f) for f in fields if f != "id"] or [F.lit(None).alias("none_")]
    linked = known.groupBy(key, "recording_id_").agg(F.first("sources").alias("sources"), F.bool_or(F.col("recording").isNotNull()).alias("known"), F.struct(*shown).alias("r"))
    linked = linked.withColumn("r", F.struct(F.col("recording_id_").alias("id"), *[F.col("r").getField(f).alias(f) for f in fields if f != "id"]))
    found = known.where("recording is not null").select(key, "recording_id_", "recording_id").join(of.lines, "recording_id").drop("recording_id").repartition(key)
    if "m2" in words:
        made = second_format(linked, found, key)
    elif words & {"recordings", "recordingids", "isrcs"}:
        made = recordings(linked, found, key, words, of.groups)
        if "usermeta" in words and submitted is not None:
            made = made.select(key, F.to_json("recordings").alias("own_"))
            sent = user_recordings(results, linked.where("known").select(key).distinct(), submitted, key).select(key, F.to_json("recordings").alias("sent_"))
            both = made.join(sent, key, "full")
            inner = F.concat_ws(",", *[F.expr(f"substring({c}, 2, length({c}) - 2)") for c in ("own_", "sent_")])
            return results.join(both.select(key, F.concat(F.lit('{"recordings":['), inner, F.lit("]}")).alias("document")), key, "left")
    elif words & {"releasegroups", "releasegroupids"}:
        made = release_groups(found, [key], words, of.groups)
    elif words & {"releases", "releaseids"}:
        made = releases(found, [key], words)
    else:
        return results.withColumn("document", F.lit(None).cast("string"))
    made = made.select(key, F.to_json(F.struct(*[c for c in made.columns if c != key])).alias("document"))
    return results.join(made, key, "left")


def user_recordings(results: DataFrame, found: DataFrame, submitted: DataFrame, key: str) -> DataFrame:
    """key and recordings, made of submitted metadata: no ids, no empty titles; only for queries of which no result was found."""
    from sonarium.operators.statistics import top_per_group

    known = results.join(found, key, "left_semi").select("query_id").distinct()
    best = top_per_group(submitted, "track_id", MOST_METADATA, F.desc("submission_count"), "meta_id")
    held = results.join(known, "query_id", "left_anti").select(key, "track_id").join(best, "track_id")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    artists = F.when(text("artist").isNotNull(), F.array(F.struct(text("artist").alias("name"))))
    releases = F.when(text("album").isNotNull(), F.array(F.struct(text("album").alias("title"))))
    item = F.struct("place", F.struct(text("title").alias("title"), artists.alias("artists"), releases.alias("releases")).alias("r"))
    return held.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("recordings"))


def unseen(links: DataFrame, rows: DataFrame) -> DataFrame:
    """mbid of links that the catalogue has no recording for: they are to be looked into."""
    return links.select("mbid").distinct().join(rows.select(F.col("recording.id").alias("mbid")), "mbid", "left_anti")
