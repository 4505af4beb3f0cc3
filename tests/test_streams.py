"""The change log in storage and as a source, kept messages, and limits over a stream."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from sonarium.operators import requests as rq
from sonarium.streaming import feed, limits, log


def inserted(spark, low, high):
    return spark.createDataFrame([(i, [i * 16] * 3) for i in range(low, high)], "id long, hashes array<int>")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def run(spark, folder, out, checkpoint, **options):
    stream = log.changes_stream(spark, folder, **options)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.id, r.fingerprint_id, tuple(r["query"])) for r in spark.read.parquet(out).collect())


def test_the_log_as_a_source(spark, tmp_path):
    held = log.ChangeLog(spark, f"file://{tmp_path}/log")
    held.append(inserted(spark, 100, 130), date(2024, 1, 5))
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    want = [(i - 99, i, (i * 16,)) for i in range(100, 180)]
    assert run(spark, held.folder, out, checkpoint, page=7) == want[:30]
    held.append(inserted(spark, 130, 160), date(2024, 2, 5))
    held.append(inserted(spark, 160, 180), date(2024, 6, 1))
    assert run(spark, held.folder, out, checkpoint, page=7) == want  # after a restart nothing is lost, and nothing comes twice
    assert run(spark, held.folder, f"{tmp_path}/late", f"{tmp_path}/late-checkpoint", after=65) == want[65:]

    one = held.rows(60)
    assert sorted(r.id for r in one.collect()) == list(range(61, 81)) and "month" in plan(one) and plan(one).count("2024-06-01") and not plan(one).count("2024-01-01")
    assert sorted(r.id for r in held.page(25, 10).collect()) == list(range(26, 36)) and held.page(80, 5).count() == 0
    done = held.maintain(date(2024, 6, 20))
    assert done["drop"] == ["2024-01-01", "2024-02-01"] and done["create"][0] == "2024-07-01" and len(done["create"]) == 12
    assert held.floor() == 60 and held.last() == 80 and sorted(r.id for r in held.rows(60).collect()) == list(range(61, 81))
    with pytest.raises(feed.Gone):
        held.rows(59)
    with pytest.raises(Exception, match="changes up to 60 are gone"):
        run(spark, held.folder, f"{tmp_path}/gone", f"{tmp_path}/gone-checkpoint", after=5)
    assert held.append(inserted(spark, 1, 1).limit(0), date(2024, 6, 21)) is None
    assert held.append(inserted(spark, 5, 7), date(2024, 6, 21)).first == 81


def test_the_newest_message_is_kept(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "subject string, lsn int, body string").withColumn("lsn", F.col("lsn").cast("decimal(20,0)"))
    folder = f"file://{tmp_path}/messages"
    first, second = batch(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), batch(("a", 1, "old"), ("b", 5, "new"), ("c", 1, "w"))
    for rows in (first, second, second, first):
        log.keep_messages(spark, rows, folder)
    assert sorted((r.subject, int(r.lsn), r.body) for r in log.kept_messages(spark, folder).collect()) == [("a", 2, "y"), ("b", 5, "new"), ("c", 1, "w")]


def test_a_stream_is_limited_like_a_table(spark, tmp_path):
    rng = random.Random(3)
    hits = [(k, rng.randrange(0, 400) if rng.random() < 0.9 else rng.randrange(0, 1500)) for k in "ab" for _ in range(300)]
    df = spark.createDataFrame(sorted(hits, key=lambda h: h[1]), "k string, t long").select("k", F.timestamp_seconds("t").alias("t"))
    want = {(r.k, r.bucket): (r.hits, r.accepted) for r in rq.limited(df, "k", "t", 0.5).collect()}
    folder = f"{tmp_path}/hits"
    parts = [df.where("t < timestamp_seconds(200)"), df.where("t >= timestamp_seconds(200)"), spark.sql("SELECT 'end' AS k, timestamp_seconds(3000000) AS t")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get(limits.STORE[0])
    spark.conf.set(*limits.STORE)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
        out = limits.limited_stream(stream, "k", "t", 0.5, late="1000000 seconds")
        out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(limits.STORE[0], before)
    got = {(r.key, r.bucket): (r.hits, r.accepted) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(k, b): v for (k, b), v in want.items()}
