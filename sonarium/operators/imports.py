"""The import of submissions: gate, search, assignment to tracks, new rows, counted links with provenance, and results.

Submissions depend on each other: a later one may match what an earlier one brought. They are imported in
rounds. Of submissions that are alike, or share a lock, only the earliest goes in a round; the others wait for
the next, and then see its rows. A round works on all that may go at once, and says what it changes: rows that are new, and counts of rows
that are there. A store keeps the tables in ranges of their keys, and writes only the ranges that a round touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.functions import text as tx
from sonarium.operators import clusters as cl
from sonarium.operators import links as lk
from sonarium.operators import search as se
from sonarium.operators.index import TermIndex, remove_index
from sonarium.operators.state import find_or_insert, numbered
from sonarium.sources.tables import Scratch, shared_folder

LINKS = ("mbid", "puid", "meta_id", "foreignid")
META = "STRUCT<track: STRING, artist: STRING, album: STRING, album_artist: STRING, track_no: INT, disc_no: INT, year: INT>"
_META_FIELDS = ("track", "artist", "album", "album_artist", "track_no", "disc_no", "year")
#: What a submission brings. Its source is a known one (source_id), or an application's account and version; its format and metadata are known ones by id, or new.
SUBMISSION = (
    "id LONG, created TIMESTAMP, hashes ARRAY<INT>, length INT, bitrate INT, format_id LONG, format STRING, source_id LONG, application_id LONG, account_id LONG, "
    f"application_version STRING, mbid STRING, puid STRING, meta_id LONG, meta {META}, foreignid_id LONG, foreignid STRING"
)
_KINDS = {"mbid": "STRING", "puid": "STRING", "meta_id": "LONG", "foreignid": "STRING"}
_LINK = "id LONG, track_id LONG, {0} {1}, submission_count LONG, disabled BOOLEAN, merged_into LONG"
_PROVENANCE = "link_id LONG, submission_id LONG, source_id LONG"
RESULT = (
    "submission_id LONG, created TIMESTAMP, handled_at TIMESTAMP, account_id LONG, application_id LONG, application_version STRING, fingerprint_id LONG, track_id LONG, "
    "meta_gid STRING, meta_id LONG, mbid STRING, puid STRING, foreignid STRING"
)
#: The tables of a store: their columns, and the key by whose ranges they lie.
TABLES = {
    "fingerprints": ("id LONG, track_id LONG, hashes ARRAY<INT>, length INT, bitrate INT, format_id LONG, submission_count LONG", "id"),
    "tracks": ("id LONG, new_id LONG", "id"),
    "metas": ("id LONG, gid STRING, track STRING, artist STRING, album STRING, album_artist STRING, track_no INT, disc_no INT, year INT", "id"),
    "sources": ("id LONG, application_id LONG, account_id LONG, version STRING", "id"),
    "formats": ("id LONG, name STRING", "id"),
    "foreignids": ("id LONG, foreignid STRING", "id"),
    "fingerprint_sources": ("fingerprint_id LONG, submission_id LONG, source_id LONG", "fingerprint_id"),
    "results": (RESULT, "submission_id"),
} | {f"{kind}_{c}": (ddl.format(c, _KINDS[c]), key) for c in LINKS for kind, ddl, key in (("links", _LINK, "track_id"), ("provenance", _PROVENANCE, "link_id"))}


@dataclass(frozen=True)
class State:
    """The tables by name (see TABLES), and the scores that decide where a submission goes."""

    tables: dict[str, DataFrame]
    scores: dict[str, float] = field(default_factory=lambda: {"track_score": cl.TRACK_SCORE, "same_score": cl.SAME_SCORE})

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def links(self) -> dict[str, DataFrame]:
        return {c: self.tables[f"links_{c}"] for c in LINKS}

    @property
    def provenance(self) -> dict[str, DataFrame]:
        return {c: self.tables[f"provenance_{c}"] for c in LINKS}

    def top(self, name: str) -> int:
        """The largest id of a table."""
        return self.tables[name].agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]

    def with_tables(self, **tables: DataFrame) -> State:
        return replace(self, tables=self.tables | tables)


def empty_state(spark: SparkSession, **scores: float) -> State:
    state = State({name: spark.createDataFrame([], ddl) for name, (ddl, _) in TABLES.items()})
    return replace(state, scores=state.scores | scores)


def submissions(rows: DataFrame) -> DataFrame:
    """Rows with all columns of SUBMISSION; those that are lacking are null."""
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], SUBMISSION).schema}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def prepared(rows: DataFrame) -> DataFrame:
    """Submissions with their metadata put in order: white space is one blank, too large numbers go, nothing at all is null; meta_gid is its content id."""
    fixed = {c: tx.fix_number(F.col(f"meta.{c}")) if c in ("track_no", "disc_no") else F.col(f"meta.{c}") if c == "year" else tx.fix_text(F.col(f"meta.{c}")) for c in _META_FIELDS}
    some = F.coalesce(*[F.col(f"meta.{c}").cast("string") for c in _META_FIELDS]).isNotNull()
    held = rows.withColumn("meta", F.when(some, F.struct(*[v.alias(c) for c, v in fixed.items()])))
    gid = tx.meta_id(**{c: F.col(f"meta.{c}") for c in _META_FIELDS})
    return held.withColumn("meta_gid", F.when(F.col("meta").isNotNull() & F.col("meta_id").isNull(), gid))


def free(queue: DataFrame) -> DataFrame:
    """Of submissions (id, hashes, mbid) the earliest of each bit vote and of each catalogue id: the others wait, as behind a lock."""
    vote = Window.partitionBy(fp.simhash("hashes")).orderBy("id")
    item = Window.partitionBy("mbid").orderBy("id")
    marked = queue.withColumns({"a_": F.row_number().over(vote), "b_": F.when(F.col("mbid").isNull(), 1).otherwise(F.row_number().over(item))})
    return marked.where("a_ = 1 and b_ = 1").drop("a_", "b_")


def waiting(queue: DataFrame, track_score: float, common: int = se.COMMON) -> DataFrame:
    """id of the submissions that an earlier one in the queue may match: they are searched among each other.

    An earlier one counts if the submission's own search could come to it: were all earlier ones imported, it must be among the first
    candidates by shared terms, within the length band, and score enough. So each submission has at most as many pairs as a
    search has candidates, whatever terms they share; see search.candidates()."""
    corpus = queue.select("id", "hashes", "length", F.col("id").alias("group"))
    asked = queue.select(F.col("id").alias("query_id"), "hashes", "length")
    terms = se.term_index(corpus, every_term=True)
    most, percent = se.FULL
    pairs = se.candidates(se.term_index(asked, "query_id"), terms, most=most, least_percent=percent, common=common, earlier=True)
    near = se.scored(asked, corpus, pairs.select("query_id", "id"), track_score, cl.LENGTH_BAND, 1)
    return near.select(F.col("query_id").alias("id")).distinct()


def joinable_tracks(matches: DataFrame, submissions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """query_id and track: tracks of the matches all of whose fingerprints are near enough to the submission, in score and length."""
    asked = submissions.select(F.col("id").alias("query_id"), F.col("hashes").alias("a"), F.col("length").alias("a_length"))
    held = fingerprints.select(F.col("track_id").alias("track"), F.col("hashes").alias("b"), F.col("length").alias("b_length"))
    pairs = matches.select("query_id", "track").distinct().join(asked, "query_id").join(held, "track")
    return cl.joinable(pairs.select("query_id", "track", fp.compare("a", "b").alias("score"), F.abs(F.col("a_length") - F.col("b_length")).alias("length_diff")))


@dataclass(frozen=True)
class Changes:
    """What a round changes: rows to add by table, and rows that take the place of those with their id."""

    added: dict[str, DataFrame]
    changed: dict[str, DataFrame]


def _sourced(state: State, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Submissions with the account, application and version of their source, and the sources that are new. An unknown source_id refuses a submission."""
    keys = ["application_id", "account_id", "version"]
    named = rows.withColumnRenamed("application_version", "version")
    asked = named.where("source_id is null").select(keys)
    sources = scratch.keep(find_or_insert(state.sources, asked, keys), "sources")
    known = named.where("source_id is not null").drop(*keys).join(state.sources.withColumnRenamed("id", "source_id"), "source_id")
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    of = sources.withColumnsRenamed({k: f"s_{k}" for k in keys} | {"id": "s_id"})
    new = named.where("source_id is null").join(of, same).withColumn("source_id", F.col("s_id")).drop("s_id", *[f"s_{k}" for k in keys])
    return known.select(new.columns).unionByName(new), sources.join(state.sources.select("id"), "id", "left_anti")


def round_changes(state: State, rows: DataFrame, scratch: Scratch, handled_at: Column | None = None, index: TermIndex | None = None) -> Changes:
    """What submissions (see SUBMISSION) that do not depend on each other change. Refused ones leave nothing. Ids ascend with the submissions' ids.

    index: the terms of all fingerprints, if kept."""
    none = F.lit(None).cast("timestamp")
    handled_at = F.current_timestamp() if handled_at is None else handled_at
    good = scratch.keep(cl.importable(prepared(submissions(rows))), "good")
    rows, sources = _sourced(state, good, scratch)
    rows = scratch.keep(rows, "rows")
    corpus = state.fingerprints.select("id", "hashes", "length", F.col("id").alias("group"), "track_id")
    asked = rows.select(F.col("id").alias("query_id"), "hashes", "length")
    found = se.search(asked, corpus, least_score=state.scores["track_score"], limit=se.MOST_STORED, index=index)
    matches = scratch.keep(found.join(corpus.select("id", F.col("track_id").alias("track")), "id").select("query_id", "id", "track", "score"), "matches")
    given = cl.assign(matches, joinable_tracks(matches, rows, state.fingerprints), **state.scores)
    placed = scratch.keep(rows.join(given.select(F.col("query_id").alias("id"), F.col("track").alias("old_track"), F.col("id").alias("old_print")), "id", "left"), "placed")
    ids = lambda missing, table, name: numbered(placed.where(f"{missing} is null").select("id"), ["id"]).select("id", (F.col("n") + F.lit(state.top(table))).alias(name))
    placed = placed.join(ids("old_track", "tracks", "new_track"), "id", "left").join(ids("old_print", "fingerprints", "new_print"), "id", "left")
    # Formats and metadata that are new, by name and by content.
    formats = scratch.keep(find_or_insert(state.formats, rows.where("format is not null and format_id is null").select(F.col("format").alias("name")), ["name"]), "formats")
    placed = placed.join(formats.select(F.col("id").alias("new_format"), F.col("name").alias("format")), "format", "left")
    contents = rows.where("meta_gid is not null").groupBy(F.col("meta_gid").alias("gid")).agg(F.min_by("meta", "id").alias("m")).join(state.metas.select("gid"), "gid", "left_anti")
    top = state.top("metas")
    new_metas = scratch.keep(numbered(contents, ["gid"]).select((F.col("n") + F.lit(top)).alias("id"), "gid", "m.*"), "metas")
    metas = state.metas.select("id", "gid").unionByName(new_metas.select("id", "gid"))
    by_gid, by_id = metas.select(F.col("gid").alias("meta_gid"), F.col("id").alias("own_meta")), state.metas.select(F.col("id").alias("meta_id"), F.col("gid").alias("known_gid"), F.lit(True).alias("meta_known"))
    placed = placed.join(by_gid, "meta_gid", "left").join(by_id, "meta_id", "left")
    placed = placed.join(state.foreignids.select(F.col("id").alias("foreignid_id"), F.col("foreignid").alias("known_foreignid")), "foreignid_id", "left")
    zero = F.lit(cl.ZERO_ID)
    done = placed.select(
        F.col("id").alias("submission_id"),
        "created",
        F.coalesce(handled_at, none).alias("handled_at"),
        "account_id",
        "application_id",
        F.col("version").alias("application_version"),
        F.coalesce("old_print", "new_print").alias("fingerprint_id"),
        F.coalesce("old_track", "new_track").alias("track_id"),
        F.coalesce("known_gid", F.when(F.col("meta_id").isNull(), F.col("meta_gid"))).alias("meta_gid"),
        F.coalesce(F.when(F.col("meta_known"), F.col("meta_id")), F.when(F.col("meta_id").isNull(), F.col("own_meta"))).alias("meta_id"),
        F.nullif(F.nullif("mbid", F.lit("")), zero).alias("mbid"),
        F.nullif(F.nullif("puid", F.lit("")), zero).alias("puid"),
        F.when(F.col("foreignid_id").isNotNull(), F.col("known_foreignid")).otherwise(F.when(tx.is_foreign_id(F.col("foreignid")), F.col("foreignid"))).alias("foreignid"),
        "source_id",
        "old_print",
        "new_track",
        "hashes",
        "length",
        "bitrate",
        F.coalesce("format_id", "new_format").alias("format_id"),
    )
    done = scratch.keep(done, "done")
    again = done.where("old_print is not null").groupBy(F.col("fingerprint_id").alias("id")).agg(F.count("*").alias("again_"))
    names = state.fingerprints.columns
    counted = state.fingerprints.join(again, "id").withColumn("submission_count", F.col("submission_count") + F.col("again_")).select(names)
    fresh = done.where("old_print is null").select(F.col("fingerprint_id").alias("id"), "track_id", "hashes", "length", "bitrate", "format_id", F.lit(1).cast("long").alias("submission_count"))
    wanted = done.where("foreignid is not null").select("foreignid")
    changed = {"fingerprints": counted}
    added = {
        "fingerprints": fresh,
        "tracks": done.where("new_track is not null").select(F.col("track_id").alias("id"), F.lit(None).cast("long").alias("new_id")),
        "metas": new_metas,
        "sources": sources,
        "formats": formats.join(state.formats.select("id"), "id", "left_anti"),
        "foreignids": find_or_insert(state.foreignids, wanted, ["foreignid"]).join(state.foreignids.select("id"), "id", "left_anti"),
        "fingerprint_sources": done.select("fingerprint_id", "submission_id", "source_id"),
        "results": done.select(state.results.columns),
    }
    for item in LINKS:
        events = done.where(F.col(item).isNotNull()).select("track_id", item, "submission_id", "source_id")
        made = lk.link_changes(state.links[item], events, item, state.top(f"links_{item}"))
        changed[f"links_{item}"], added[f"links_{item}"], added[f"provenance_{item}"] = made.counted, made.added, made.provenance
    return Changes(added, changed)


def import_round(state: State, rows: DataFrame, handled_at: Column | None = None) -> State:
    """The state after submissions that do not depend on each other, as tables that are worked out when read; what is assigned once is written to the shared folder."""
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        made = round_changes(state, rows, scratch, handled_at)
        after = dict(state.tables)
        for name, new in made.changed.items():
            after[name] = after[name].join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new)
        for name, new in made.added.items():
            after[name] = after[name].unionByName(new.select(after[name].columns))
        touched = {*made.changed, *made.added}
        return state.with_tables(**{name: scratch.keep(df, name, outlive=True) for name, df in after.items() if name in touched})


class Store:
    """The tables of a state in one folder of the shared storage, each in ranges of its key (column part), with the term index of its fingerprints.

    Rows are added as new files; rows that change take the place of those in their ranges, which alone are read and written for that."""

    def __init__(self, state: State, spark: SparkSession, size: int = 1 << 16):
        self.spark, self.size, self.scores = spark, size, state.scores
        self.folder = shared_folder(spark, "imported")
        self.tops = {name: state.top(name) for name, (ddl, _) in TABLES.items() if ddl.startswith("id ")}
        for name in TABLES:
            self._write(name, state.tables[name])
        self.index = se.empty_index(spark).updated(state.fingerprints)

    def _part(self, name: str) -> Column:
        return F.floor(F.coalesce(F.col(TABLES[name][1]), F.lit(0)) / self.size).cast("long")

    def _write(self, name: str, rows: DataFrame, overwrite: bool = False) -> None:
        dealt = rows.withColumn("part", self._part(name)).repartition("part")
        writer = dealt.write.partitionBy("part").mode("overwrite" if overwrite else "append")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        ddl = f"{TABLES[name][0]}, part LONG"
        rows = self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}")
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")

    def state(self) -> State:
        state = _StoredState({name: self.table(name) for name in TABLES}, self.scores)
        object.__setattr__(state, "tops", self.tops)
        return state

    def take(self, made: Changes, scratch: Scratch) -> dict[str, list[int]]:
        """Writes what a round changes; the ranges that each table had to write anew."""
        # All is worked out from the tables as they were before any is written.
        changed = {name: scratch.keep(rows, name) for name, rows in made.changed.items()}
        added = {name: scratch.keep(rows, name) for name, rows in made.added.items()}
        touched: dict[str, list[int]] = {}
        for name, rows in changed.items():
            parts = sorted(r[0] for r in rows.select(self._part(name)).distinct().collect())
            if parts:
                held = self.table(name, parts)
                self._write(name, scratch.keep(held.join(rows.select("id"), "id", "left_anti").select(rows.columns).unionByName(rows), name), overwrite=True)
                touched[name] = parts
        for name, rows in added.items():
            if name in self.tops:
                self.tops[name] = max(self.tops[name], rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
            self._write(name, rows)
        if not added["fingerprints"].isEmpty():
            self.index = self.index.updated(added["fingerprints"].select("id", "hashes"))
        return touched


@dataclass(frozen=True)
class _StoredState(State):
    """A store's tables, whose largest ids are known."""

    def top(self, name: str) -> int:
        return self.__dict__["tops"][name]


def rounds(store: Store, queue: DataFrame, handled_at: Column | None = None) -> Iterator[dict[str, list[int]]]:
    """Imports all submissions of a queue into a store; what each round touched. There are as many rounds as the longest chain of submissions that wait for each other."""
    spark = queue.sparkSession
    with Scratch(spark) as outer:
        rows = outer.keep(submissions(queue), "queue")
        while not rows.isEmpty():
            with Scratch(spark) as scratch:
                good = scratch.keep(cl.importable(prepared(rows)), "good")
                behind = good.select("id").join(free(good).select("id"), "id", "left_anti").unionByName(waiting(good, store.scores["track_score"])).distinct()
                behind = scratch.keep(behind, "behind")
                made = round_changes(store.state(), rows.join(behind, "id", "left_anti"), scratch, handled_at, store.index)
                yield store.take(made, scratch)
                rows = outer.keep(rows.join(behind, "id", "left_semi"), "queue")


def import_all(state: State, queue: DataFrame, handled_at: Column | None = None) -> tuple[State, int]:
    """The state after all submissions of a queue, as tables of a store in the shared folder, and the number of rounds."""
    store = Store(state, queue.sparkSession)
    n = sum(1 for _ in rounds(store, queue, handled_at))
    remove_index(store.index)
    return store.state(), n


def statuses(submissions: DataFrame, results: DataFrame, tracks: DataFrame) -> DataFrame:
    """id, status (pending, or imported once there is a result) and the gid of the track that the result leads to. tracks: id, gid, new_id."""
    end = tracks.select(F.col("id").alias("track_id"), F.coalesce("new_id", "id").alias("end_")).join(tracks.select(F.col("id").alias("end_"), "gid"), "end_")
    held = results.select(F.col("submission_id").alias("id"), "track_id").join(end, "track_id", "left")
    joined = submissions.select("id").join(held, "id", "left")
    return joined.select("id", F.when(F.col("track_id").isNull(), "pending").otherwise("imported").alias("status"), "gid")
