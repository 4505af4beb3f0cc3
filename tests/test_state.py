"""Numbers in order, redirects followed to their ends, merges in chains, positions of a log."""

import random

import pytest

from sonarium.functions import fingerprint as fp
from sonarium.operators import accounts as ac
from sonarium.operators import links as lk
from sonarium.operators import state as st
from sonarium.streaming import feed


def test_numbers_ascend_with_the_keys(spark):
    rng = random.Random(1)
    keys = [(None if rng.random() < 0.1 else rng.randrange(5), f"k{i}") for i in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(keys, "a int, b string").repartition(5)
    rows = sorted((r.n, r.a, r.b) for r in st.numbered(df, ["a", "b"], buckets=16, per_bucket=4).collect())
    assert [r[0] for r in rows] == list(range(1, 3001))
    assert [r[1:] for r in rows] == sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert sorted(r.n for r in st.numbered(spark.createDataFrame([(1,)] * 5, "a int"), ["a"]).collect()) == [1, 2, 3, 4, 5]
    assert st.numbered(df.limit(0), ["a", "b"]).count() == 0


def test_a_row_is_not_compared_with_every_edge(spark):
    df = spark.createDataFrame([(None if i % 9 == 0 else i * 37 % 100, i) for i in range(500)], "a int, b int").repartition(3)
    want = sorted(((r.a, r.b) for r in df.collect()), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    for buckets in (1, 2, 3, 5, 33):
        got = st.numbered(df, ["a", "b"], buckets=buckets, per_bucket=3)
        assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.n)] == want
    plan = st.numbered(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    # Six halvings find one of 64 ranges, for the places and again for the sizes; no function runs over the edges.
    assert "filter(edges_" not in plan and plan.count("<= struct(a") == 12


def test_redirects_are_followed_to_their_ends(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (101, 100), (200, None), (5, 6)]
    got = {r.id: r.target for r in st.closure(spark.createDataFrame(chain, "id long, target long")).collect()}
    assert got == {i: 40 for i in [*range(1, 40), 100, 101]}
    for bad in ([(1, 2), (2, 3), (3, 1)], [(1, 1)], [(i, (i + 1) % 7) for i in range(7)] + [(9, 0)]):
        with pytest.raises(st.Cycle):
            st.closure(spark.createDataFrame(bad, "id long, target long"))
    with pytest.raises(st.Ambiguous):
        st.closure(spark.createDataFrame([(1, 2), (1, 3)], "id long, target long"))
    assert st.closure(spark.createDataFrame([], "id long, target long")).count() == 0


def test_chained_merges_count_each_link_once(spark):
    new = spark.createDataFrame
    links = new([(1, 1, "a", 5), (2, 2, "a", 7), (3, 3, "b", 1), (4, 9, "a", 2)], "id long, track_id long, mbid string, submission_count long")
    tracks = new([(1, None), (2, None), (3, None), (4, 1), (9, None), (8, 9), (3000, 8)], "id long, new_id long")
    tables = lk.TrackTables({"mbid": links}, {"mbid": new([(i, i) for i in range(1, 5)], "link_id long, submission_id long")}, new([(2, True)], "link_id long, disabled boolean"), new([(1, 1), (2, 2)], "id long, track_id long"), tracks)
    after = lk.merged_tracks(tables, new([(1, 2), (2, 3), (3, 8)], "track_id long, target long"))
    assert sorted(map(tuple, after.links["mbid"].select("id", "track_id", "mbid", "submission_count").collect())) == [(1, 9, "a", 14), (3, 9, "b", 1)]
    assert sorted(map(tuple, after.provenance["mbid"].select("submission_id", "link_id").collect())) == [(1, 1), (2, 1), (3, 3), (4, 1)]
    assert [r.link_id for r in after.audit.collect()] == [1] and {r.track_id for r in after.fingerprints.collect()} == {9}
    assert {r.id: r.new_id for r in after.tracks.collect()} == {1: 9, 2: 9, 3: 9, 4: 9, 9: None, 8: 9, 3000: 9}
    with pytest.raises(st.Cycle):
        lk.merged_tracks(tables, new([(1, 2), (2, 1)], "track_id long, target long"))
    with pytest.raises(st.Ambiguous):
        lk.merged_tracks(tables, new([(1, 2), (1, 3)], "track_id long, target long"))


def test_positions_follow_the_inserts(spark):
    log = spark.createDataFrame([(7, 1, [1])], "id long, fingerprint_id long, query array<bigint>")
    inserted = spark.createDataFrame([(i, [i * 16] * 3 + [fp.SILENCE]) for i in range(1, 8)], "id long, hashes array<int>")
    rows = sorted((r.id, r.fingerprint_id) for r in feed.captured(log, inserted).collect())
    assert rows == [(7, 1)] + [(7 + i, i) for i in range(1, 8)]


def test_new_rows_and_keys(spark):
    state = spark.createDataFrame([(1, "x", "a")], "id long, content string, note string")
    new = spark.createDataFrame([(2, "x", "b"), (4, "y", "c"), (3, "y", "d")], "id long, content string, note string")
    assert sorted(map(tuple, st.inserted_once(state, new, "content", "id").collect())) == [(1, "x", "a"), (3, "y", "d")]
    _, given = ac.inserted(spark.createDataFrame([(9, "z")], "id long, name string"), spark.createDataFrame([("b",), ("a",), ("a",)], "name string"))
    assert sorted(map(tuple, given.collect())) == [(10, "a"), (11, "a"), (12, "b")]
    assert len(ac.new_key()) == 10 and ac.new_key(30).isalnum() and ac.new_key() != ac.new_key()
