"""Links, merges and the import of submissions, on small tables whose outcomes are known."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.operators import clusters as cl
from sonarium.operators import imports as im
from sonarium.operators import links as lk
from sonarium.operators import lookup as lo
from tests import goldens

LINK = "id long, track_id long, mbid string, submission_count long, disabled boolean, merged_into long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_items_are_merged_on_every_track(spark):
    links = spark.createDataFrame([(1, 1, "new", 9, False, None), (2, 1, "old", 11, False, None), (3, 2, "old", 5, True, None), (4, 3, "new", 1, True, None), (5, 4, "other", 2, False, None)], LINK)
    after, moved = lk.merged_item(links, "old", "new", "mbid")
    got = {r.id: (r.track_id, r.mbid, r.submission_count, r.disabled, r.merged_into) for r in after.collect()}
    assert got == {1: (1, "new", 20, False, None), 2: (1, "old", 0, True, 1), 3: (2, "old", 0, True, 6), 6: (2, "new", 5, False, None), 4: (3, "new", 1, True, None), 5: (4, "other", 2, False, None)}
    provenance = spark.createDataFrame([(2, 100), (1, 101), (3, 102)], "link_id long, submission_id long")
    assert rows(lk.followed(provenance, moved), "link_id", "submission_id") == [(1, 100), (1, 101), (6, 102)]
    again, _ = lk.merged_item(after, "old", "new", "mbid")  # it may be asked for twice
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
    with pytest.raises(lk.AlreadyMerged):
        lk.merged_item(after, "old", "other", "mbid")


@pytest.mark.parametrize("both", [[False, False], [True, False], [True, True]])
def test_a_merged_item_is_disabled_only_if_both_were(spark, both):
    links = spark.createDataFrame([(1, 1, "new", 9, both[0], None), (2, 1, "old", 11, both[1], None)], LINK)
    after, _ = lk.merged_item(links, "old", "new", "mbid")
    assert rows(after.where("id = 1"), "submission_count", "disabled") == [(20, all(both))]


def test_tracks_are_merged_with_all_that_hangs_on_them(spark):
    new = spark.createDataFrame
    mbids = new([(1, 1, "a", 10, False, None), (2, 1, "b", 15, True, None), (3, 2, "b", 50, True, None), (4, 3, "a", 25, True, None), (5, 4, "c", 30, False, None), (6, 9, "a", 1, False, None)], LINK)
    puids = new([(1, 2, "x", 1), (2, 3, "x", 2)], "id long, track_id long, puid string, submission_count long")
    tables = lk.TrackTables(
        {"mbid": mbids, "puid": puids},
        {"mbid": new([(i, 10 * i) for i in range(1, 7)], "link_id long, submission_id long"), "puid": new([(1, 7), (2, 8)], "link_id long, submission_id long")},
        new([(3, True), (4, False), (6, True)], "link_id long, disabled boolean"),
        new([(1, 1), (2, 2), (3, 9)], "id long, track_id long"),
        new([(1, None), (2, None), (3, None), (4, None), (8, 2), (9, None)], "id long, new_id long"),
    )
    after = lk.merged_tracks(tables, new([(1, 3), (2, 3), (4, 3)], "track_id long, target long"))
    assert rows(after.links["mbid"], "id", "track_id", "mbid", "submission_count", "disabled") == [(1, 3, "a", 35, False), (2, 3, "b", 65, True), (5, 3, "c", 30, False), (6, 9, "a", 1, False)]
    assert rows(after.links["puid"], "id", "track_id", "submission_count") == [(1, 3, 3)]
    assert rows(after.provenance["mbid"], "submission_id", "link_id") == [(10, 1), (20, 2), (30, 2), (40, 1), (50, 5), (60, 6)]
    assert rows(after.provenance["puid"], "submission_id", "link_id") == [(7, 1), (8, 1)]
    assert rows(after.audit, "link_id", "disabled") == [(1, False), (2, True), (6, True)]
    assert rows(after.fingerprints, "id", "track_id") == [(1, 3), (2, 3), (3, 9)]
    assert {r.id: r.new_id for r in after.tracks.collect()} == {1: 3, 2: 3, 3: None, 4: 3, 8: 3, 9: None}


def test_switches_leave_a_trace(spark):
    links = spark.createDataFrame([(1, 1, "a", 1, False, None), (2, 2, "a", 1, True, None), (3, 1, "b", 1, False, None)], LINK)
    one = spark.createDataFrame([("a",)], "mbid string")
    after, audit = lk.disabled(links, one, "mbid", "gone", 5)
    assert rows(after, "id", "disabled") == [(1, True), (2, True), (3, False)]
    assert rows(audit, "link_id", "disabled", "note", "account_id") == [(1, True, "gone", 5), (2, True, "gone", 5)]
    after, audit = lk.toggled(links, spark.createDataFrame([(2,), (3,)], "id long"), "why")
    assert rows(after, "id", "disabled") == [(1, False), (2, False), (3, True)]
    assert rows(audit, "link_id", "disabled", "note") == [(2, False, "why"), (3, True, "why")]


def test_missing_items_are_followed(spark):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "mbid string")
    unknown = spark.createDataFrame([("c", "2024-01-01"), ("e", "2024-01-04")], "mbid string, unknown_since string")
    found = lk.follow_missing(one("a", "b", "c", "e", "f"), one("a", "b", "c", "d", "e", "f"), spark.createDataFrame([("a", "z")], "mbid string, target string"), one("b"), unknown, F.to_date(F.lit("2024-01-09")), "mbid")
    got = {r.mbid: (r.outcome, r.target, None if r.unknown_since is None else str(r.unknown_since)) for r in found.collect()}
    assert got == {"a": ("merged", "z", None), "b": ("kept", None, None), "c": ("expired", None, None), "e": ("unknown", None, "2024-01-04"), "f": ("unknown", None, "2024-01-09")}


def test_upserts_count_and_remember(spark):
    links = spark.createDataFrame([(4, 1, "a", 3, False, None)], LINK)
    events = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 1), (1, "b", 12, 2), (2, "a", 13, 2)], "track_id long, mbid string, submission_id long, source_id long")
    after, provenance = lk.upserted(links, events, "mbid")
    got = {(r.track_id, r.mbid): (r.id, r.submission_count) for r in after.collect()}
    assert got[1, "a"] == (4, 5) and {got[1, "b"], got[2, "a"]} == {(5, 1), (6, 1)}
    assert sorted((r.submission_id, r.link_id) for r in provenance.collect()) == [(10, 4), (11, 4), (12, got[1, "b"][0]), (13, got[2, "a"][0])]


# Import of known fingerprints.

SONGS = ["song_320k", "song_160k", "song_64k", "song_32k", "other_song"]


@pytest.fixture(scope="module")
def known():
    return {name: fp.decode_legacy(text)[1].astype("uint32").view("int32").tolist() for name, text in goldens.SAMPLES.items()}


QUEUE = f"id long, hashes array<int>, length int, application_id long, account_id long, application_version string, mbid string, puid string, meta {im.META}, foreignid string"


def submission(known, i, name, length=260, **fields):
    held = {"mbid": None, "puid": None, "meta": None, "foreignid": None} | (fields or {"mbid": "m1"})
    meta = held["meta"] and (held["meta"], *[None] * 6)
    return (i, known[name], 320 if name == "other_song" else length, 5, 6, "v1", held["mbid"], held["puid"], meta, held["foreignid"])


def corpus(spark, known, **scores):
    """The best copy of a song, as fingerprint 1 on track 1 of four tracks."""
    state = im.empty_state(spark, **scores)
    prints = spark.createDataFrame([(1, 1, known["song_320k"], 260, None, None, 1)], state.fingerprints.schema)
    tracks = spark.createDataFrame([(i, None) for i in range(1, 5)], state.tracks.schema)
    return state.with_tables(fingerprints=prints, tracks=tracks)


@pytest.mark.parametrize(
    "name, scores, want",
    [("song_160k", {}, (1, 1)), ("song_320k", {}, (1, 1)), ("song_64k", {"same_score": 0.95}, (2, 1)), ("song_32k", {"track_score": 0.9}, (2, 5)), ("other_song", {}, (2, 5))],
)
def test_where_a_submission_goes(spark, known, name, scores, want):
    queue = spark.createDataFrame([submission(known, 7, name, mbid="m1", foreignid="v:1", meta="a\n\t title")], QUEUE)
    after = im.import_round(corpus(spark, known, **scores), queue)
    (result,) = after.results.collect()
    assert (result.fingerprint_id, result.track_id) == want
    assert (result.submission_id, result.mbid, result.foreignid, result.meta_id) == (7, "m1", "v:1", 1)
    counts = {r.id: r.submission_count for r in after.fingerprints.collect()}
    assert counts == ({1: 2} if want[0] == 1 else {1: 1, 2: 1})
    assert rows(after.links["mbid"], "track_id", "mbid", "submission_count") == [(want[1], "m1", 1)]
    assert rows(after.provenance["foreignid"], "submission_id", "source_id") == [(7, 1)]
    (meta,) = after.metas.collect()
    assert (meta.track, meta.gid) == ("a title", result.meta_gid) and rows(after.sources, "id", "application_id", "account_id", "version") == [(1, 5, 6, "v1")]
    assert (result.account_id, result.application_id, result.application_version, result.handled_at is None) == (6, 5, "v1", False)


def test_a_queue_into_an_empty_store(spark, known):
    """Two songs, one of them twice: the second copy waits for the first."""
    queue = spark.createDataFrame([submission(known, 1, "song_320k", mbid="m1"), submission(known, 2, "other_song", mbid="m2"), submission(known, 3, "song_320k", mbid="m1"), submission(known, 4, "other_song", puid=cl.ZERO_ID)], QUEUE)
    state, rounds = im.import_all(im.empty_state(spark), queue)
    assert rounds == 2 and state.fingerprints.count() == 2 and state.tracks.count() == 2
    got = {r.submission_id: (r.fingerprint_id, r.track_id) for r in state.results.collect()}
    assert sorted(got) == [1, 2, 3] and got[1] == got[3] != got[2]
    assert {r.mbid: r.submission_count for r in state.links["mbid"].collect()} == {"m1": 2, "m2": 1}
    assert state.provenance["mbid"].count() == 3 and {r.id for r in state.tracks.collect()} == {1, 2}


def folders(spark, name):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    return {x for x in os.listdir(base) if x.startswith(name)} if os.path.isdir(base) else set()


def test_a_round_writes_what_it_touches(spark, known):
    """Known fingerprints in far ranges stay as they are; a round with one of them writes its range, and adds files elsewhere."""
    other = known["other_song"]
    state = im.empty_state(spark)
    prints = [(1, 1, known["song_320k"], 260, None, None, 1), (70_000, 70_000, other, 320, None, None, 1)]
    links = [(1, 1, "m1", 1, False, None), (2, 70_000, "m2", 5, False, None)]
    state = state.with_tables(fingerprints=spark.createDataFrame(prints, state.fingerprints.schema), tracks=spark.createDataFrame([(1, None), (70_000, None)], state.tracks.schema), links_mbid=spark.createDataFrame(links, state.links["mbid"].schema))
    before = {x: folders(spark, x) for x in ("rows", "done", "queue", "known", "matches")}
    store = im.Store(state, spark)
    queue = spark.createDataFrame([submission(known, 1, "other_song", mbid="m2"), submission(known, 2, "song_160k", mbid="m9")], QUEUE)
    (touched,) = im.rounds(store, queue)
    assert touched == {"fingerprints": [0, 1], "links_mbid": [1]} or touched == {"fingerprints": [1], "links_mbid": [1]}
    after = store.state()
    assert {r.id: r.submission_count for r in after.fingerprints.collect()}[70_000] == 2
    assert sorted((r.track_id, r.mbid, r.submission_count) for r in after.links["mbid"].collect()) == [(1, "m1", 1), (1, "m9", 1), (70_000, "m2", 6)]
    assert {x: folders(spark, x) for x in before} == before  # nothing on the way stays
    again = spark.createDataFrame([submission(known, 5, "other_song", mbid="m2")], QUEUE)
    assert [t["links_mbid"] for t in im.rounds(store, again)] == [[1]]
    assert {r.id: r.submission_count for r in store.state().fingerprints.collect()}[70_000] == 3


def test_metadata_sources_and_foreign_ids_are_checked(spark, known):
    state = im.empty_state(spark)
    state = state.with_tables(
        sources=spark.createDataFrame([(4, 1, 2, None)], state.sources.schema),
        metas=spark.createDataFrame([(8, "g8", "t", None, None, None, None, None, None)], state.metas.schema),
        foreignids=spark.createDataFrame([(3, "v:3")], state.foreignids.schema),
        formats=spark.createDataFrame([(2, "MP3")], state.formats.schema),
    )
    hashes = lambda k: [(i * 7919 + k * 104729) * 16 for i in range(90)]
    meta = ("x  y", "", None, None, 20_000, 3, 1999)
    held = [
        (1, hashes(1), 100, 4, None, None, None, 8, None, 3, "MP3", "m"),
        (2, hashes(2), 100, 99, None, None, None, None, None, None, None, "m"),
        (3, hashes(3), 100, None, 1, 2, None, 9, None, None, "FLAC", "m"),
        (4, hashes(4), 100, None, 1, 2, "b", None, meta, 7, None, None),
        (5, hashes(5), 100, None, 1, 2, "b", None, (*[None] * 7,), None, None, None),
    ]
    names = f"id long, hashes array<int>, length int, source_id long, application_id long, account_id long, application_version string, meta_id long, meta {im.META}, foreignid_id long, format string, mbid string"
    after = im.import_round(state, spark.createDataFrame(held, names), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = {r.submission_id: (r.application_id, r.account_id, r.application_version, r.meta_id, r.meta_gid is None, r.foreignid) for r in after.results.collect()}
    assert got == {1: (1, 2, None, 8, False, "v:3"), 3: (1, 2, None, None, True, None), 4: (1, 2, "b", 9, False, None)}
    assert {r.id: (r.track, r.track_no, r.disc_no, r.year) for r in after.metas.collect()}[9] == ("x y", None, 3, 1999)
    assert sorted(map(tuple, after.sources.collect())) == [(4, 1, 2, None), (5, 1, 2, "b")] and {r.name: r.id for r in after.formats.collect()} == {"MP3": 2, "FLAC": 3}
    assert [r.id for r in after.fingerprints.orderBy("id").collect()] == [1, 2, 3] and {r.id: r.format_id for r in after.fingerprints.collect()} == {1: 2, 2: 3, 3: None}
    assert {str(r.handled_at) for r in after.results.collect()} == {"2024-01-02 03:04:05"}


def test_waiting_needs_few_pairs(spark, monkeypatch):
    """One term is in every submission; two are copies of earlier ones. The pairs stay in proportion to the submissions."""
    def queue(n):
        rows = [(i, [16] + [(i * 1000 + k) * 1024 for k in range(100)], 100) for i in range(n)]
        return spark.createDataFrame([*rows, (n, rows[3][1], 100), (n + 1, rows[n - 1][1], 103)], "id long, hashes array<int>, length int")

    pairs = []
    kept = im.se.scored
    monkeypatch.setattr(im.se, "scored", lambda asked, corpus, found, *rest: pairs.append(found.count()) or kept(asked, corpus, found, *rest))
    for n in (150, 300):
        assert sorted(r.id for r in im.waiting(queue(n), cl.TRACK_SCORE, common=50).collect()) == [n, n + 1]
    assert pairs[1] <= 2.2 * pairs[0] and pairs[1] <= 20 * 302


def test_gate(spark, known):
    good = known["song_320k"]
    cases = [("mbid", "m", good, None), ("mbid", cl.ZERO_ID, good, "nothing named"), ("puid", "p", good, None), ("puid", cl.ZERO_ID, good, "nothing named"), ("meta", "t", good, None), ("mbid", "", good, "nothing named"), ("mbid", "m", good[:79], "too few hashes"), ("mbid", "m", [1] * 200, "too few hashes"), ("mbid", "m", None, "too few hashes")]
    held = [(i, h, *[v if k == c else None for c in ("mbid", "puid", "meta")]) for i, (k, v, h, _) in enumerate(cases)]
    got = cl.gated(spark.createDataFrame(held, "id long, hashes array<int>, mbid string, puid string, meta string")).orderBy("id").collect()
    assert [r.refused for r in got] == [c[-1] for c in cases]


def test_which_tracks_may_merge_or_take_more(spark, known):
    members = spark.createDataFrame([(1, i, i, 260 if i < 3 else 320, known[n]) for i, n in ((1, "song_320k"), (2, "song_160k"), (3, "other_song"))], "block long, id long, track long, length int, hashes array<int>")
    pairs = [(r.a, r.b) for r in cl.mergeable(cl.track_pairs(members)).collect()]
    assert pairs == [(1, 2)]
    matrix = {(r.a, r.b): r.score for r in cl.similarity_matrix(members).collect()}
    assert len(matrix) == 9 and matrix[1, 1] == 1.0 and matrix[1, 2] == matrix[2, 1] > 0.9 and matrix[1, 3] < 0.4
    assert cl.similarity_matrix(members.where("id = 1")).count() == 0
    prints = spark.createDataFrame([(1, 1, known["song_320k"], 260, 1)], "id long, track_id long, hashes array<int>, length int, submission_count long")
    asked = spark.createDataFrame([(1, known["other_song"], 320), (2, known["song_160k"], 280), (3, known["song_160k"], 260)], "id long, hashes array<int>, length int")
    matches = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "query_id long, track long")
    assert [r.query_id for r in im.joinable_tracks(matches, asked, prints).collect()] == [3]


def test_statuses(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    results = spark.createDataFrame([(1, 10), (2, 11)], "submission_id long, track_id long")
    tracks = spark.createDataFrame([(10, "g10", None), (11, "g11", 10)], "id long, gid string, new_id long")
    assert sorted(map(tuple, im.statuses(ids, results, tracks).collect())) == [(1, "imported", "g10"), (2, "imported", "g10"), (3, "pending", None)]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "v"), (3, "b", None)], "id long, name string, version string")
    assert lo.scalar(df, "id", name="a", version=None) == 1 and lo.scalar(df, "id", name="a", version="v") is None
    assert lo.one_or_none(df, name="c") is None
    with pytest.raises(lo.NotOne):
        lo.one_or_none(df, name="b")
    assert [r.id for r in lo.page(df, "id", 1, 5).collect()] == [2, 3] and [r.id for r in lo.page(df, "id", 1, 1, inclusive=True).collect()] == [1]
    many = spark.range(1, 101).withColumnRenamed("id", "k")
    got = [sorted(r.k for r in part.collect()) for part in lo.chunks(many, "k", 40, 10)]
    assert got == [list(range(1, 41)), list(range(41, 81)), list(range(81, 90))]
    assert list(lo.chunks(many.where("false"), "k")) == []


def test_equal_fingerprints_of_tracks_are_compared_once(spark, monkeypatch):
    """Three contents in two tracks of two blocks: at most 3 * 3 comparisons a block and pair of tracks, and what all pairs give."""
    rng = random.Random(5)
    kinds = {i: [rng.getrandbits(31) for _ in range(40)] for i in range(3)}
    rows = [(i % 2, i // 2, rng.randrange(3), rng.choice([None, *range(90, 130)]), kinds[rng.randrange(3)]) for i in range(300)]
    rows += [(7, 1, 0, 5, kinds[0]), (7, 1, 1, 90, kinds[0]), (8, 2, 0, None, None), (8, 3, 1, 4, kinds[1]), (9, 5, 0, 1, kinds[0]), (9, 4, 1, 1, kinds[0])]
    members = spark.createDataFrame(rows, "block long, id long, track long, length int, hashes array<int>")
    compared = spark.sparkContext.accumulator(0)

    def counting(x, y):
        compared.add(1)
        return None if x is None or y is None else fp.similarity(x, y)

    monkeypatch.setattr(fp, "compare", F.udf(counting, "double"))
    want = {}
    for ba, ia, ta, la, ha in rows:
        for bb, ib, tb, lb, hb in rows:
            if ba == bb and ia < ib and ta < tb:
                scores, lengths = want.setdefault((ba, ta, tb), ([], []))
                scores += [] if ha is None or hb is None else [(tuple(ha), tuple(hb))]
                lengths += [] if la is None or lb is None else [abs(la - lb)]
    want = {k: (min((round(fp.similarity(*p), 9) for p in set(s)), default=None), max(d, default=None)) for k, (s, d) in want.items()}
    got = {(r.block, r.a, r.b): (None if r.score is None else round(r.score, 9), r.length_diff) for r in cl.track_pairs(members).collect()}
    assert got == want
    assert compared.value <= 2 * 3 * 9 + 3
