"""Feeds, change sources, the wire form, the index, dumps, documents and accounts."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.operators import accounts as ac
from sonarium.operators import documents as dc
from sonarium.operators import search as se
from sonarium.operators import statistics as sx
from sonarium.sources import tables as tb
from sonarium.streaming import changes as ch
from sonarium.streaming import feed, wire

LOG = "id long, fingerprint_id long, query array<int>"


def test_pages_of_the_feed(spark):
    log = spark.createDataFrame([(i, 100 + i, [i, -i]) for i in range(1, 11)], LOG)
    page = feed.read_page(log, 4, 3)
    assert [e[0] for e in page.entries] == [5, 6, 7] and page.retry_after_ms == feed.BUSY_WAIT
    assert page.entries[0] == (5, 105, [5, 2**32 - 5])
    assert feed.read_page(log, 8, 3).retry_after_ms == feed.IDLE_WAIT
    assert feed.read_page(log, 0, 0) == feed.Page([], feed.IDLE_WAIT) == feed.read_page(log, 0, -5)
    assert len(feed.read_page(log, 2, 10**9, floor=2).entries) == 8
    with pytest.raises(feed.Gone):
        feed.read_page(log, 1, 3, floor=2)
    for index, generation in (("other", 1), (feed.INDEX, 2)):
        with pytest.raises(feed.UnknownLineage):
            feed.read_page(log, 0, 3, index=index, generation=generation)
    assert feed.index_feed(0, 5) == [(1, "create", feed.INDEX)] and feed.index_feed(1, 5) == [] == feed.index_feed(0, 0)


def test_capture_continues_the_log(spark):
    log = spark.createDataFrame([(7, 1, [1])], LOG)
    inserted = spark.createDataFrame([(i, [i * 16] * 3 + [fp.SILENCE]) for i in range(20)], "id long, hashes array<int>")
    rows = feed.captured(log.withColumn("query", F.col("query").cast("array<bigint>")), inserted).collect()
    assert sorted(r.id for r in rows) == list(range(7, 28))
    assert {r.fingerprint_id: r["query"] for r in rows if r.id > 7} == {i: [i * 16] for i in range(20)}


def test_bootstrap(spark):
    corpus = spark.createDataFrame([(i, [16 * i] if i % 5 else [fp.SILENCE]) for i in range(1, 12)] + [(20, [fp.SILENCE]), (21, [fp.SILENCE])], "id long, hashes array<int>")
    parts = list(feed.bootstrap_stream(corpus, 42, 4))
    assert parts[0] == 42 and parts[-1] == [] and all(parts[1:-1])
    assert [i for p in parts[1:-1] for i, _ in p] == [i for i in range(1, 12) if i % 5]
    assert {r.id: r.terms for r in feed.bootstrap_rows(corpus, 4).collect()} == {i: [16 * i] for i in range(1, 12) if i % 5}
    log = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(1, 11)], "id long, key long, value string")
    snapshot = spark.createDataFrame([(0, 3, "v3"), (1, 1, "v1"), (9, 0, "old")], "key long, id long, value string")
    assert {r.key: r.value for r in feed.bootstrap(snapshot, log, "key", 3).collect()} == {0: "v9", 1: "v10", 2: "v8", 9: "old"}


def test_pace():
    pace = feed.Pace()
    assert [round(pace.next(False), 2) for _ in range(3)] == [1.3, 1.69, 2.2]
    for _ in range(20):
        pace.next(False)
    assert pace.wait == 10 and pace.next(True) == pytest.approx(10 / 1.3)
    quick = feed.Pace(0.05, 1.0, 2.0, reset=True)
    assert [quick.next(False) for _ in range(6)] == [0.1, 0.2, 0.4, 0.8, 1.0, 1.0] and quick.next(True) == 0.05


def unpack(raw, at=0):
    """A reader of the binary form, for the tests."""
    b = raw[at]
    at += 1
    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if 0xA0 <= b < 0xC0:
        return raw[at : at + b - 0xA0].decode(), at + b - 0xA0
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if b in range(0xCC, 0xD4):
        size = 1 << (b & 3)
        return int.from_bytes(raw[at : at + size], "big", signed=b >= 0xD0), at + size
    if b in (0xD9, 0xDA, 0xDB, 0xC4, 0xC5, 0xC6):
        size = 1 << ((b - (0xD9 if b >= 0xD9 else 0xC4)))
        n = int.from_bytes(raw[at : at + size], "big")
        part = raw[at + size : at + size + n]
        return (part.decode() if b >= 0xD9 else part), at + size + n
    if b < 0xA0:
        n, pairs = b & 15, b < 0x90
    else:
        size = 2 if b in (0xDC, 0xDE) else 4
        n, pairs = int.from_bytes(raw[at : at + size], "big"), b >= 0xDE
        at += size
    out = []
    for _ in range(n * (2 if pairs else 1)):
        value, at = unpack(raw, at)
        out.append(value)
    return (dict(zip(out[::2], out[1::2], strict=True)) if pairs else out), at


def test_wire_form(spark):
    values = [None, True, False, "", "é" * 40, b"\0" * 300, [], {}, {"a": [1, {"b": None}]}, list(range(70_000)), {str(i): i for i in range(20)}, "x" * 70_000]
    values += [s * (1 << k) + d for k in range(0, 63) for s in (1, -1) for d in (-1, 0, 1)]
    for v in values:
        raw = wire.pack(v)
        assert unpack(raw) == (v, len(raw))
    # The narrowest form of each number.
    assert [wire.pack(v).hex() for v in (127, 128, -32, -33, 65536, -129)] == ["7f", "cc80", "e0", "d0df", "ce00010000", "d1ff7f"]
    assert unpack(wire.page_bytes([(5, 9, [1, 2**32 - 1])], 1000))[0] == {"e": [{"i": 5, "c": {"i": {"i": 9, "h": [1, 2**32 - 1]}}}], "r": 1000}
    assert unpack(wire.pack([wire.delete_change(3)]))[0] == [{"d": {"i": 3}}]
    assert unpack(wire.index_feed_bytes(feed.index_feed(0, 1), 0))[0] == {"o": [{"p": 1, "k": 0, "i": feed.INDEX}], "r": 0}
    parts = list(wire.bootstrap_bytes([7, [(1, [2])], []]))
    assert [unpack(p)[0] for p in parts] == [{"p": 7}, [{"i": {"i": 1, "h": [2]}}], []]
    df = spark.createDataFrame([(1, [5]), (2, None)], "id long, terms array<bigint>").coalesce(1)
    assert [r.b and bytes(r.b) for r in df.select(wire.insert_bytes(F.col("id"), F.col("terms")).alias("b")).collect()] == [wire.pack(wire.insert_change(1, [5])), None]


def line(action, lsn, id_=None, hashes=None, table="fingerprint"):
    own = [{"name": "id", "type": "integer", "value": id_}]
    held = [{"name": "fingerprint", "type": "integer[]", "value": hashes}] if hashes else []
    body = {"action": action, "lsn": lsn, "xid": 5, "schema": "public", "table": table}
    body |= {"columns": (own if action == "I" else []) + held} if action in "IU" else {}
    body |= {"identity": own} if action in "UD" else {}
    return json.dumps(body)


def test_row_changes_feed_an_index(spark, tmp_path):
    files = [
        [line("B", "0/1"), line("I", "0/2", 1, "{16,32}"), line("I", "0/3", 2, "{48}"), line("I", "0/4", 9, "{1}", table="other"), line("C", "0/5")],
        [line("U", "0/A", 1, "{64}"), line("I", "0/B", 3, "{80}"), line("D", "0/C", 2)],
        [line("U", "1/0", 3, "{96}"), line("U", "0/FFFFFFFF", 3, "{112}")],
    ]
    folder = tmp_path / "changes"
    folder.mkdir()
    for i, lines in enumerate(files):
        path = folder / f"{i}.json"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    held, seen = [se.empty_index(spark)], []

    def apply(batch, number):
        seen.append(number)
        held[0] = ch.apply_to_index(held[0], batch, number)

    ch.follow(spark, str(folder), str(tmp_path / "checkpoint"), apply)
    assert seen == [0, 1, 2] and held[0].attribute(ch.SEQUENCE) == 2
    assert sorted((r.id, r.term) for r in held[0].terms.collect()) == [(1, 64), (3, 96)]
    again = ch.apply_to_index(held[0], ch.decoded(spark.createDataFrame([(line("D", "2/0", 1),)], "value string")), 2)
    assert again is held[0]  # the batch is known already
    assert ch.initial_load(spark.createDataFrame([(1, [16])], "id long, hashes array<int>")).first().action == "I"


def test_broken_changes_stop_the_stream(spark):
    lines = spark.createDataFrame([(line("I", "0/1", 1),), (line("D", "0/2", 1),)], "value string")
    assert [r.broken for r in ch.decoded(lines).orderBy("lsn").collect()] == [True, False]
    with pytest.raises(ch.BrokenChange):
        ch.checked(ch.decoded(lines))


def test_newest_message_of_a_subject(spark):
    changes = lambda *rows: spark.createDataFrame(rows, "lsn decimal(20,0), action string, id long, hashes array<int>")
    from decimal import Decimal as D

    old, new = changes((D(1), "I", 1, [16]), (D(2), "I", 2, [32])), changes((D(3), "D", 1, None))
    kept = {r.subject: json.loads(r.body) for r in ch.kept_messages(ch.message(old), ch.message(new)).collect()}
    assert kept["changes.1"] == {"id": 1, "kind": "delete", "query": []} or kept["changes.1"]["kind"] == "delete"
    assert kept["changes.2"] == {"id": 2, "kind": "insert", "query": [32], "simhash": 32}


def prints(spark, rows):
    return spark.createDataFrame(rows, "id long, hashes array<int>, length int, group long")


def test_search_finds_what_is_not_indexed_yet(spark):
    base = [i * 16 for i in range(200)]
    corpus = prints(spark, [(1, base, 100, 1), (2, base[:150] + [7] * 50, 100, 1), (3, base, 104, 2), (4, base, 120, 3), (9, base, 101, 4)])
    asked = spark.createDataFrame([(1, base, 100)], "query_id long, hashes array<int>, length int")
    index = se.term_index(corpus.where("id < 9"), every_term=True)
    got = lambda **o: [(r.id, r["rank"], round(r.score, 3)) for r in se.search(asked, corpus, index=index, **o).orderBy("rank").collect()]
    assert got() == [(1, 1, 1.0), (3, 2, 1.0)]
    assert got(newest=8) == [(1, 1, 1.0), (3, 2, 1.0), (9, 3, 1.0)]
    assert [x[0] for x in got(newest=8, length_band=None)] == [1, 3, 4, 9]
    assert [x[0] for x in got(newest=8, limit=2)] == [1, 3]
    assert got(least_score=1.0) == []  # a score at the limit is not enough
    fast = se.search(asked, corpus, *se.FAST)
    assert fast.count() == 3
    tracks = spark.createDataFrame([(1, "g1", None), (2, "g2", None), (4, "g4", 1)], "id long, gid string, new_id long")
    wanted = spark.createDataFrame([(5, "g4"), (6, "nobody")], "query_id long, gid string")
    rows = sorted(map(tuple, se.lookup(asked, wanted, corpus.where("group < 3"), tracks).collect()))
    assert rows == [(1, "g1", 1, 1.0), (1, "g2", 2, 1.0), (5, "g4", 1, 1.0)]


def test_index_grows_and_forgets(spark):
    corpus = spark.createDataFrame([(i, [16 * i, fp.SILENCE]) for i in range(1, 8)], "id long, hashes array<int>")
    index = se.empty_index(spark)
    assert index.grown(corpus.where("false")) is index
    index = index.grown(corpus, 4).grown(corpus, 2)
    assert index.info() == {"documents": 6, "terms": 6, se.NEWEST: 6}
    changed = spark.createDataFrame([(1, [160]), (2, None), (50, [16])], "id long, hashes array<int>")
    after = index.updated(changed, {"other": 3})
    assert sorted((r.id, r.term) for r in after.terms.collect()) == [(1, 160), (3, 48), (4, 64), (5, 80), (6, 96), (50, 16)]
    assert after.attribute("other") == 3 and after.attribute(se.NEWEST) == 6 and after.attribute("none", -1) == -1


def test_requests_are_bounded_in_number_and_time(spark):
    assert se.batch([1, 2], [3], several=False) == ([1], []) and se.batch([], [3, 4], several=False) == ([], [3])
    assert se.batch([1] * 20, [2] * 100, several=True) == ([1] * 20, [2] * 100)
    with pytest.raises(se.TooMany):
        se.batch([1] * 21, [], several=True)
    assert len(se.rows_within(spark.range(3), 60)) == 3
    slow = spark.range(0, 4, 1, 4).select(F.expr("reduce(sequence(1, 30000000), 0D, (a, x) -> a + sqrt(x) + id)").alias("x"))
    assert se.rows_within(slow, 0.2) == []


def test_dump_brings_every_text_back(spark, tmp_path):
    texts = ["", "\\N", "a\tb\nc\r\n", "\\", "\\\\n", "\\n", "é😀\x0b\x08\x0c", None, "N", "\\t\\", "{1}"]
    rows = [(i, t, [1, -2] if i % 2 else [], bytearray(b"\0\xff") if i % 3 else None, i % 2 == 0, 0.1 * i) for i, t in enumerate(texts)]
    schema = "id int, t string, a array<int>, b binary, f boolean, d double"
    df = spark.createDataFrame(rows, schema)
    tb.dump(df, str(tmp_path / "x"))
    assert sorted(map(tuple, tb.load(spark, str(tmp_path / "x"), schema).collect())) == sorted(map(tuple, df.collect()))
    assert tb.export({"b": df, "a": df.select("id")}, str(tmp_path / "all")) == ["a", "b"]
    assert tb.load(spark, str(tmp_path / "all" / "a"), "id int").count() == len(texts)


def test_shared_folder_is_not_made_up_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(RuntimeError):
        tb.shared_folder(Cluster, "x")


def test_keys():
    key = ac.demo_key("secret", date(2024, 1, 10))
    assert len(key) == 11 and key[-2] == "A" and key == ac.demo_key("secret", date(2024, 1, 10)) != ac.demo_key("other", date(2024, 1, 10))
    assert ac.is_demo_key("secret", key, date(2024, 1, 10)) and ac.is_demo_key("secret", key, date(2024, 1, 4))
    assert not ac.is_demo_key("secret", key, date(2024, 1, 3)) and not ac.is_demo_key("secret", key, date(2024, 1, 11)) and not ac.is_demo_key("secret", "x")
    keys = {ac.new_key() for _ in range(50)}
    assert len(keys) == 50 and all(k.isalnum() and len(k) == 10 for k in keys)


def test_accounts(spark):
    rows = spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2")], "id long, name string, apikey string")
    changed = ac.edited(rows, "id", spark.createDataFrame([(2, None, "new")], "id long, name string, apikey string"))
    assert sorted(map(tuple, changed.collect())) == [(1, "a", "k1"), (2, "b", "new")]
    after, given = ac.inserted(rows, spark.createDataFrame([("c", "x"), ("c", "x")], "name string, apikey string"))
    assert after.count() == 4 and sorted(r.id for r in given.collect()) == [3, 4]
    assert [tuple(r) for r in ac.by_login(rows, spark.createDataFrame([(2, "url")], "account_id long, login string")).collect()] == [(2, "b", "url")]
    assert [r.id for r in ac.without(rows, spark.createDataFrame([(1,)], "id long"), "id").collect()] == [2]


def test_statistics_on_little(spark):
    stats = spark.createDataFrame([("a", "2024-01-01", 3), ("a", "2024-01-02", 5), ("a", "2024-01-04", 4), ("b", "2024-01-02", 7)], "name string, date string, value long").withColumn("date", F.to_date("date"))
    got = {(r.name, str(r.date)): r.change for r in sx.changes_by_day(stats).collect()}
    assert got == {("a", "2024-01-02"): 2, ("a", "2024-01-04"): -1, ("b", "2024-01-02"): 7}
    assert sorted((str(r.date), r.a, r.b) for r in sx.pivoted(sx.changes_by_day(stats), ["a", "b"]).collect()) == [("2024-01-02", 2, 7), ("2024-01-04", -1, 0)]
    assert [tuple(r) for r in sx.snapshot(stats).collect()] == [("a", 4)]
    empty = spark.createDataFrame([(0, 5), (1, 0)], "bucket int, n long")
    assert [tuple(r) for r in sx.shares(empty).collect()] == [(1, 0, "0.00")]
    assert [tuple(r) for r in sx.with_and_without(spark.createDataFrame([], "name string, value long")).collect()] == [(0, 0, "0.00")]
    assert sx.window(days=3, today=date(2024, 3, 2)) == (date(2024, 2, 28), date(2024, 3, 1))
    months = spark.createDataFrame([("2024-01-05",), ("2024-02-01",), ("2024-04-01",)], "month string")
    assert sx.unbroken_months(months, date(2024, 1, 1)) == 2 and sx.unbroken_months(months, date(2024, 3, 1)) == 0


def catalogue_rows(spark):
    new = spark.createDataFrame
    tables = {
        "recording": new([(1, "r1", "Song", 5, None), (2, "r2", "Unheard", 5, 2000)], "id int, gid string, name string, artist_credit int, length int"),
        "artist_credit_name": new([(5, 1, 8, "B", ""), (5, 0, 7, "A", " & ")], "artist_credit int, position int, artist int, name string, join_phrase string"),
        "artist": new([(7, "a7"), (8, "a8")], "id int, gid string"),
        "track": new([("t1", 1, 3, 2, "Song", 5, 9000), ("t2", 1, 3, 1, "Song (live)", 5, None)], "gid string, recording int, medium int, position int, name string, artist_credit int, length int"),
        "medium": new([(3, 4, 1, None, 1, 9)], "id int, release int, position int, name string, format int, track_count int"),
        "medium_format": new([(1, "CD")], "id int, name string"),
        "release": new([(4, "l4", "Album", 5, 6)], "id int, gid string, name string, artist_credit int, release_group int"),
        "release_event": new([(4, "FR", 2001, 0, None), (4, "DE", 2002, 5, 1)], "release int, country string, year int, month int, day int"),
        "release_group": new([(6, "g6", "Album", 5, 1)], "id int, gid string, name string, artist_credit int, type int"),
        "primary_type": new([(1, "EP")], "id int, name string"),
        "secondary_type": new([(6, "Live"), (6, "Demo")], "release_group int, name string"),
        "isrc": new([(1, "Z"), (1, "C"), (1, "C")], "recording int, isrc string"),
    }
    return dc.flat(tables, isrcs=True)


def test_documents(spark):
    rows = catalogue_rows(spark).cache()
    results = spark.createDataFrame([("x", 10, 1), ("y", 11, 2)], "result_id string, track_id long, query_id long")
    links = spark.createDataFrame([(10, "r1", 3), (11, "nobody", 1)], "track_id long, mbid string, submission_count long")

    def made(*words, **options):
        return {r.result_id: r.document and json.loads(r.document) for r in dc.documents(results, links, rows, set(words), **options).collect()}

    credit = [{"id": "a7", "name": "A", "joinphrase": " & "}, {"id": "a8", "name": "B"}]
    assert made("recordings", "isrcs") == {"x": {"recordings": [{"id": "r1", "title": "Song", "artists": credit, "isrcs": ["C", "Z"]}]}, "y": {"recordings": [{"id": "nobody"}]}}
    events = [{"country": "DE", "date": {"year": 2002, "month": 5, "day": 1}}, {"country": "FR", "date": {"year": 2001}}]
    release = {"id": "l4", "title": "Album", "medium_count": 1, "track_count": 9, "artists": credit, "releaseevents": events, "country": "DE", "date": events[0]["date"]}
    assert made("releases")["x"] == {"releases": [release]}
    tracks = [{"position": 1, "id": "t2", "title": "Song (live)", "artists": credit}, {"position": 2, "id": "t1", "title": "Song", "artists": credit}]
    medium = {"position": 1, "track_count": 9, "format": "CD", "tracks": tracks}
    assert made("releases", "tracks")["x"]["releases"][0]["mediums"] == [medium]
    group = {"id": "g6", "title": "Album", "type": "EP", "secondarytypes": ["Demo", "Live"], "artists": credit}
    assert made("releasegroups")["x"] == {"releasegroups": [group]}
    full = made("recordings", "releasegroups", "releases", "tracks", "compress", "sources")["x"]["recordings"][0]
    short = {k: v for k, v in release.items() if k not in ("title", "artists")} | {"mediums": [medium | {"tracks": [{"position": 1, "id": "t2", "title": "Song (live)"}, {"position": 2, "id": "t1"}]}]}
    assert full == {"id": "r1", "title": "Song", "artists": credit, "sources": 3, "releasegroups": [{k: v for k, v in group.items() if k != "artists"} | {"releases": [short]}]}
    assert made("recordingids", "sources")["y"] == {"recordings": [{"id": "nobody", "sources": 1}]} and made("m2")["y"] == {"recordings": [{"id": "nobody"}]}
    assert made("releases")["y"] is None and made("recordings", "releasegroups")["y"] == {"recordings": [{"id": "nobody"}]}
    second = made("m2")["x"]["recordings"][0]
    assert [t["title"] for t in second["tracks"]] == ["Song (live)", "Song"] and second["tracks"][1]["medium"] == {"track_count": 9, "position": 1, "release": {"id": "l4", "title": "Album"}, "format": "CD"}
    sent = spark.createDataFrame([(11, 1, 2, "x", "", None), (11, 2, 9, "", "me", "alb"), (10, 3, 1, "no", None, None)], "track_id long, meta_id long, submission_count long, title string, artist string, album string")
    users = made("recordings", "usermeta", submitted=sent)
    assert users["y"] == {"recordings": [{"id": "nobody"}, {"artists": [{"name": "me"}], "releases": [{"title": "alb"}]}, {"title": "x"}]} and "artists" in users["x"]["recordings"][0]
    assert made() == {"x": None, "y": None}
    assert [r.mbid for r in dc.unseen(links, rows).collect()] == ["nobody"]


@pytest.mark.parametrize("name", ["o093_compressed", "o090_nested_documents"])
def test_lines_are_read_once_for_a_document(spark, name):
    """Lists on all levels are made of one reading of the lines."""
    from sonarium.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.split("\n") if "Relation" in line and "l_partkey#" in line]) == 1
