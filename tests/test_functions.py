import re
import time
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.functions import text as tx
from sonarium.plans import catalogue
from tests import goldens


@pytest.fixture(scope="module")
def songs():
    return {name: fp.decode_legacy(text)[1] for name, text in goldens.SAMPLES.items()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(goldens.SAMPLES.items()), "name string, text string").withColumn("hashes", fp.decode_text("text"))


def test_known_fingerprints(rows):
    got = {r.name: r for r in rows.select("*", fp.encode_text("hashes").alias("again"), fp.content_id(F.col("hashes")).alias("gid"), fp.simhash("hashes").alias("simhash"), fp.processed(F.col("text")).alias("p")).collect()}
    for name, r in got.items():
        assert r.again == r.text
        assert (len(r.hashes), len(set(r.hashes))) == goldens.SIZES[name]
        assert (r.p.hashes, r.p.gid, r.p.simhash) == (r.hashes, r.gid, r.simhash)
    assert {k: got[k].gid for k in goldens.GIDS} == goldens.GIDS
    assert {k: got[k].simhash for k in goldens.SIMHASHES} == goldens.SIMHASHES
    assert len({r.simhash for name, r in got.items() if name != "other_song"}) == 1


def test_shingles_of_one_song_meet(rows):
    held = {r.name: set(r.s) for r in rows.select("name", fp.shingled_simhash(F.col("hashes"), 120, 90).alias("s")).collect()}
    other = held.pop("other_song")
    assert all(a & b for a in held.values() for b in held.values()) and not any(a & other for a in held.values())
    with pytest.raises(ValueError):
        fp.shingled_simhash(F.col("hashes"), 0, 1)


def test_similarity_of_known_fingerprints(songs):
    best = songs["song_320k"]
    assert fp.similarity(best, best) == 1.0
    assert fp.similarity(best, songs["song_160k"]) >= 0.9
    assert fp.similarity(best, songs["song_64k"]) >= 0.75
    assert fp.similarity(best, songs["song_32k"]) < 0.75
    assert fp.similarity(best, songs["other_song"]) < 0.4
    few = np.tile(np.arange(260), 4)[:948]
    assert fp.similarity(few, few) >= 1.0
    shared = [len(set((best[80:200] & 0xFFFFFFF0).tolist()) & set((songs[k][80:200] & 0xFFFFFFF0).tolist())) for k in ("song_160k", "song_32k", "other_song")]
    assert shared[0] > shared[1] > shared[2] == 0


def serial_similarity(a, b, most=80):
    best, least = 0.0, min(len(a), len(b))
    for o in range(-most, most + 1):
        x, y = a[max(0, o) :], b[max(0, -o) :]
        n = min(len(x), len(y))
        if n > 0:
            errors = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(x[:n], y[:n], strict=True))
            best = max(best, (1 - errors / (16 * n)) * n / least)
    return best**2


def test_similarity_looks_at_every_alignment(spark):
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 2**32, n, np.uint64), m) for n, m in ((1, 1), (5, 200), (200, 5), (130, 90), (300, 300))]
    pairs = [(a, np.append(rng.integers(0, 2**32, 3, np.uint64), a)[:m] if m <= len(a) else rng.integers(0, 2**32, m, np.uint64)) for a, m in pairs]
    for a, b in pairs:
        assert fp.similarity(a, b) == pytest.approx(serial_similarity(a, b), abs=1e-12)
    rows = [([1, 2], [1, 2]), (None, [1]), ([], [1]), ([-1], None)]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select(fp.compare("a", "b").alias("s")).collect()
    assert [r.s for r in got] == [1.0, None, 0.0, None]


def test_query_skips_silence_and_repeats(spark):
    rows = [([],), ([fp.SILENCE] * 5,), ([16, 17, 32, fp.SILENCE, -1],)]
    got = [r.q for r in spark.createDataFrame(rows, "h array<int>").select(fp.extract_query(F.col("h")).alias("q")).collect()]
    assert got == [[], [], [16, 32, 0xFFFFFFF0]]
    high = [-2000000000 + 7 * i for i in range(1, 201)]
    assert len(spark.createDataFrame([(high,)], "h array<int>").select(fp.extract_query(F.col("h")).alias("q")).first().q) == 53


def test_codecs_return_what_they_got(spark):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 2**32, n, dtype=np.uint64) for n in (0, 1, 3, 348)] + [np.zeros(5, np.uint64), np.full(3, 2**32 - 1, np.uint64)]
    for h in lists:
        version, back = fp.decode_legacy(fp.encode_legacy(h))
        assert version == 1 and back.tolist() == h.tolist()
        assert fp.decode_binary(fp.encode_binary(h, 9))[1].tolist() == h.tolist()
    assert fp.encode_binary([1, 2, 3], 99) == b"Fp\x01\x63" + bytes([1, 0, 0, 0, 3, 0, 0, 0, 1, 0, 0, 0])
    signed = [h.astype(np.uint32).view(np.int32).tolist() for h in lists] + [None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(signed)], "i int, h array<int>").coalesce(1)
    got = df.select("i", fp.decode_text(fp.encode_text("h")).alias("a"), fp.decompress(fp.compress("h")).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == signed and [r.b for r in got] == signed


def test_broken_fingerprints_are_null(spark):
    good = fp.encode_legacy(np.arange(9))
    newer = fp.encode_legacy(np.arange(9), 2)
    rows = [("good", good), ("newer", newer), ("cut", good[:9]), ("short", "AQ"), ("empty", ""), ("none", None), ("no base64", "é")]
    got = {r.n: r.h for r in spark.createDataFrame(rows, "n string, t string").select("n", fp.decode_text("t").alias("h")).collect()}
    assert got == {k: list(range(9)) if k == "good" else None for k, _ in rows}
    frames = [(b"",), (b"no zstd",), (None,)]
    assert [r.h for r in spark.createDataFrame(frames, "f binary").select(fp.decompress("f").alias("h")).collect()] == [None] * 3


def test_votes_of_odd_rows(spark):
    rows = [(None,), ([],), ([1],), ([-1, 0, 0],), ([3, 1, 2],)]
    df = spark.createDataFrame(rows, "h array<int>").coalesce(1)
    assert [r.s for r in df.select(fp.simhash("h").alias("s")).collect()] == [None, 0, 1, 0, 3]
    assert [r.s for r in df.select(fp.shingled_simhash(F.col("h"), 2, 1).alias("s")).collect()] == [None, [], [1], [0, 0, 0], [1, 0, 2]]


def test_xor_at_an_offset(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 1, 2, 9])], "a array<int>, b array<int>")
    got = [df.select(fp.xor_at(F.col("a"), F.col("b"), o).alias("x")).first().x for o in (-1, 0, 1)]
    assert got == [[0, 0, 10], [2, 3, 1], [1, 2]]


def test_words_are_hashed_once(spark, monkeypatch):
    texts = [None, "", "  ", "ab", "cd ef", "bC1 -- a9\u00e9x ab", "\u0130K \u212a", "ab" * 40, "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    rows = df.select("id", catalogue.word_hashes().alias("hashes"))
    want = [None if t is None else [int.from_bytes(md5(w.encode()).digest()[:4], "big", signed=True) for w in re.findall("[a-z0-9]+", t)] for t in (r[0] for r in df.orderBy("id").select(F.lower("text")).collect())]
    assert [r.hashes for r in rows.orderBy("id").collect()] == want
    monkeypatch.setattr(fp, "CUT", 3)
    lower = ["ab" if t is None else t for t in texts]
    assert fp._word_hashes(pa.array(lower)[2:]).to_pylist() == [[int.from_bytes(md5(w.encode()).digest()[:4], "big", signed=True) for w in re.findall("[a-z0-9]+", t)] for t in lower[2:]]
    assert fp._word_hashes(pa.array([], pa.string())).to_pylist() == []
    # No function runs over the words, and terms that are exploded do not have the hashes worked out a second time.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    terms = rows.where("hashes is not null").select(F.explode("hashes"))
    assert terms._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_array_literals(spark):
    df = spark.createDataFrame([("{1,-2}",), ("{}",), ("",)], "t string")
    assert [r.a for r in df.select(fp.parse_array(F.col("t")).alias("a")).collect()] == [[1, -2], [], None]


def test_codec_speed():
    """A thousand fingerprints of usual size in well under a second each way: no loop over bits or hashes."""
    h = np.random.default_rng(3).integers(0, 2**32, 350, np.uint64)
    began = time.time()
    for _ in range(200):
        fp.decode_legacy(fp.encode_legacy(h))
    assert time.time() - began < 2


def test_metadata_ids(spark):
    one = spark.range(1)
    # Ids that must come out.
    cases = [({}, "781f130c-a3b4-5090-a87a-816c30bed2a5"), ({"track": ""}, "781f130c-a3b4-5090-a87a-816c30bed2a5"), ({"track": "foo"}, "454238f5-bceb-53c9-8a2c-029e79b86e26"), ({"track": "lukáš"}, "9c29eeb7-47d9-5364-935a-6a36b0f3bca0"), ({"track": "foo", "year": 1}, "9acff514-86bf-5fcd-9253-03b8e91bc9ae"), ({"track": "foo", "year": 0}, "454238f5-bceb-53c9-8a2c-029e79b86e26")]
    gid = lambda fields: one.select(tx.meta_id(**{k: F.lit(v) for k, v in fields.items()}).alias("g")).first().g
    for fields, want in cases:
        assert gid(fields) == want
    assert gid({"track": "0"}) != gid({}) and gid({"track": "0", "year": 0}) == gid({"track": "0"})
    assert one.select(tx.fix_text(F.lit("foo\tbar\n\r\0baz")).alias("x")).first().x == "foo bar baz"
    assert [one.select(tx.fix_number(F.lit(n)).alias("x")).first().x for n in (1, 10000, 10001)] == [1, 10000, None]


def test_patterns(spark):
    c = F.col("v")
    u = "b81f83ee-4da4-11e0-9ed8-0025225356f3"
    df = spark.createDataFrame([("a@b.cc",), ("http://x.org/y",), ("ftp://x.org",), (None,), (u,), (u.upper(),), (u + "\n",), ("foo:bar:baz",), ("Foo:bar",), ("a b@c.d",)], "v string")
    got = [tuple(r) for r in df.select(tx.is_email(c), tx.is_url(c), tx.is_uuid(c), tx.is_foreign_id(c)).collect()]
    y, n = True, False
    assert got == [(y, n, n, n), (n, y, n, y), (n, n, n, y), (n, n, n, n), (n, n, y, n), (n, n, y, n), (n, n, n, n), (n, n, n, y), (n, n, n, n), (n, n, n, n)]
    assert spark.range(1).select(tx.partition_name("log", F.to_date(F.lit("2024-03-09")))).first()[0] == "log_202403"
    words = spark.createDataFrame([("countries",), ("results",), ("data",)], "v string")
    assert [r[0] for r in words.select(tx.singular(c)).collect()] == ["country", "result", None]


def test_calls(spark):
    names = spark.createDataFrame([("f",), ("a.b",), ("a..b",), ("1a",), (None,), ("f;x",)], "c string")
    assert [r[0] for r in names.select(tx.jsonp(F.col("c"), F.struct(F.lit(1).alias("x")))).collect()] == [f'{f}({{"x":1}})' for f in ("f", "a.b", "callback", "callback", "callback", "callback")]


def test_locks_and_shards(spark):
    import zlib

    names = ["", "a", "é", "merge:target"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(tx.lock_id(F.col("n")).alias("lock"), tx.shard(F.col("n")).alias("shard")).collect()
    assert [r.lock for r in got] == [zlib.crc32(n.encode()) & 0x7FFFFFFF for n in names]
    assert all(len(r.shard) == 2 and 0 <= int(r.shard, 16) < 256 for r in got)


def test_meta_words_are_cut_at_white_space(spark):
    from sonarium.operators import requests as rq

    cases = {"recordings tracks": ["recordings", "tracks"], "recordings,tracks": ["recordings,tracks"], "a\tb\n c": ["a", "b", "c"], "a+b": ["a+b"], "0": [], "": [], "1": ["recordingids"], "2": ["m2"], " 1": ["1"]}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "meta string").select("meta", rq.wanted(F.col("meta")).alias("w")).collect()
    assert {r.meta: r.w for r in rows} == cases | {None: []}


def test_a_dollar_sign_begins_a_name_only(spark):
    names = {"a$b": "x", "$a": "$a", "a.$b": "a.$b", "a.b$": "x", "a\n": "x", "a1._2": "a1._2"}
    rows = spark.createDataFrame([(k,) for k in names], "c string")
    got = {r.c: r.v for r in rows.select("c", tx.jsonp(F.col("c"), F.struct(F.lit(1).alias("x")), "x").alias("v")).collect()}
    assert got == {k: f'{v}({{"x":1}})' for k, v in names.items()}


def test_text_forms_take_bounded_memory():
    """A batch of many rows is encoded in parts: its peak is far below that of all its gaps, and rows come out as one by one."""
    import tracemalloc

    rng = np.random.default_rng(3)
    sizes = [0, 5, 100_000, 0, *[400] * 2500, 1, 0]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    values = rng.integers(0, 2**32, offsets[-1], dtype=np.uint32)
    known = [i != 3 for i in range(len(sizes))]
    tracemalloc.start()
    try:
        made = fp.text_forms(values, offsets, known)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6
    for i in (0, 1, 2, 3, 4, 5, 1000, 2503, 2504, 2505):
        assert made[i] == (fp.encode_legacy(values[offsets[i] : offsets[i + 1]]) if known[i] else None)
