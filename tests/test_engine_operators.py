import random
from collections import Counter

from pyspark.sql import functions as F

from sonarium.operators import clusters as cl
from sonarium.operators import requests as rq
from sonarium.operators import state as st
from sonarium.sources import tables as tb


def test_rate_limit_is_that_of_a_serial_count(spark):
    rng = random.Random(3)
    hits = [(k, rng.randrange(0, 400) if rng.random() < 0.9 else rng.randrange(0, 4000)) for k in "ab" for _ in range(300)]
    df = spark.createDataFrame(hits, "k string, t long").select("k", F.timestamp_seconds("t").alias("t"))
    got = {(r.k, r.bucket): (r.hits, r.accepted) for r in rq.limited(df, "k", "t", 0.5).collect()}
    want: Counter = Counter()
    for k, b in sorted((k, t // 5 * 5) for k, t in hits):
        if sum(want[k, b - 5 * i] for i in range(4)) < 10:
            want[k, b] += 1
    counts = Counter((k, t // 5 * 5) for k, t in hits)
    assert got == {kb: (n, want[kb]) for kb, n in counts.items()}
    assert any(h > a for h, a in got.values())


def test_parameters_are_ordered_by_number(spark):
    row = spark.range(1).select(rq.numbered(F.create_map(*map(F.lit, ("a.10", "x", "a.2", "y", "a", "z", "ab", "w", "a.b", "v"))), "a").alias("p")).first()
    assert [(e.n, e.value) for e in row.p] == [(-1, "z"), (2, "y"), (10, "x")]


def test_xml_escapes_and_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a<b&\"c\"", None, [("x",)], 1)], "name string, gone string, entries array<struct<v:string>>, `@id` int")
    assert tb.as_xml(df).first().value == '<response id="1"><entries><entry><v>x</v></entry></entries><name>a&lt;b&amp;&quot;c&quot;</name></response>'


def test_months_to_create_and_drop(spark):
    held = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-06-01', INTERVAL 1 MONTH)) AS month")
    got = sorted((r.action, str(r.month)) for r in st.partitions(held, F.to_date(F.lit("2024-05-20"))).collect())
    assert got[0] == ("create", "2024-07-01") and got[10] == ("create", "2025-05-01")
    assert got[11:] == [("drop", "2024-01-01"), ("drop", "2024-02-01")]


def test_outliers_and_groups(spark):
    rows = [("t1", "x", 0.1, 1, False), ("t1", "y", 0.9, 10, False), ("t2", "x", 0.8, 5, False), ("t1", "z", 0.1, 1, False), ("t3", "x", 0.1, 1, True), ("t3", "w", 0.9, 10, False)]
    got = cl.outliers(spark.createDataFrame(rows, "track string, mbid string, score double, sources int, manual boolean"), "track", "mbid").collect()
    assert [(r.track, r.mbid) for r in got] == [("t1", "x")]


def serial_groups(pairs):
    """One pair after another, in order: the second track joins the group that the first one is in by then."""
    into = {}
    for a, b in sorted(pairs):
        into[b] = into.get(a, a)
    return {g: {g} | {t for t, x in into.items() if x == g} for g in into.values()}


def test_tracks_merge_in_groups(spark):
    rng = random.Random(2)
    for pairs in ([(1, 2), (2, 3), (4, 5)], [(1, 3), (2, 3)], [tuple(sorted(rng.sample(range(40), 2))) for _ in range(30)]):
        got: dict = {}
        for r in cl.merge_groups(spark.createDataFrame(pairs, "a long, b long")).collect():
            got.setdefault(r.group, set()).add(r.track)
        assert got == serial_groups(set(pairs))


def test_lookups_name_their_errors(spark):
    gid = "b81f83ee-4da4-11e0-9ed8-0025225356f3"
    cases = [
        ({"trackid": gid}, 7, None, [None]),
        ({"trackid": "x"}, 7, "invalid uuid", ["invalid uuid"]),
        ({"fingerprint": "AQ", "duration": "10", "maxdurationdiff": "30"}, 30, None, [None]),
        ({"fingerprint": "AQ", "duration": "10", "maxdurationdiff": "31"}, 31, "invalid maxdurationdiff", [None]),
        ({"fingerprint": "AQ", "maxdurationdiff": "x"}, 7, "missing duration", ["missing duration"]),
        ({"duration": "5"}, 7, "missing fingerprint", []),
        ({"fingerprint.0": "AQ", "duration.0": "0", "trackid.1": gid, "fingerprint.2": "", "duration.2": "9"}, 7, None, ["missing duration", None, "missing fingerprint"]),
        ({"fingerprint.0": "", "duration.0": "1", "fingerprint.1": "A", "duration.1": "no"}, 7, "missing duration", ["missing fingerprint", "missing duration"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, p map<string, string>")
    for r, (_, band, error, errors) in zip(df.select(rq.lookup_request(F.col("p")).alias("q"), "i").orderBy("i").collect(), cases, strict=True):
        assert (r.q.band, r.q.error, [q.error for q in r.q.queries]) == (band, error, errors)


def test_noise_turns_some_bits(spark):
    df = spark.createDataFrame([(i, list(range(200)), 100) for i in range(20)], "id long, hashes array<int>, length int")
    rows = tb.noisy(df).collect()
    turned = [bin((a ^ b) & 0xFFFFFFFF).count("1") for r in rows for a, b in zip(r.hashes, range(200), strict=True)]
    assert set(turned) == {0, 1} and 0.05 < sum(turned) / len(turned) < 0.15
    assert all(92 <= r.length <= 108 for r in rows) and len({r.length for r in rows}) > 3


def test_sample_hours(spark):
    assert tb.hourly_sample(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 25


def test_repointing(spark):
    links = spark.createDataFrame([(1, 10, 2), (1, 11, 3), (2, 11, 4)], "track long, meta long, n long")
    moved = spark.createDataFrame([(10, 10), (11, 10)], "id long, canonical long")
    got = {(r.track, r.meta): r.n for r in st.repoint(links, moved, "meta", ["track", "meta"], ["n"]).collect()}
    assert got == {(1, 10): 5, (2, 10): 4}


def test_new_keys_get_the_next_ids(spark):
    state = spark.createDataFrame([(4, "k1", None)], "id long, k string, v string")
    asked = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(None).cast("string").alias("v"))
    got = {r.k: r.id for r in st.find_or_insert(state, asked, ["k", "v"]).collect()}
    assert got["k1"] == 4 and sorted(got.values()) == list(range(4, 54))


def test_rate_limit_policy(spark):
    rows = [(True, True, True, None, False), (False, True, True, None, False), (False, True, True, None, True), (True, False, True, None, False), (True, True, False, None, False), (True, True, False, 10, False)]
    c = F.col
    got = spark.createDataFrame(rows, "a boolean, g boolean, i boolean, l int, t boolean").select(rq.refused_by(c("a"), c("g"), c("i"), c("l"), c("t")).alias("r")).collect()
    assert [r.r for r in got] == [None, "application", None, "global", "address", None]


def test_parts_of_a_request(spark):
    params = F.create_map(*map(F.lit, ("length.1", "5", "fingerprint.1", "x", "fingerprint.10", "y", "length", "7")))
    (row,) = spark.range(1).select(rq.parts(rq.renamed(params), ["duration", "fingerprint"]).alias("p")).collect()
    assert [(p.n, p.duration, p.fingerprint) for p in row.p] == [(-1, "7", None), (1, "5", "x"), (10, None, "y")]
