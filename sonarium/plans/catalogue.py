"""Queries on fingerprints (words of documents as hashes), texts, requests and names; and all queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.functions import text as tx
from sonarium.operators import clusters as cl
from sonarium.operators import requests as rq
from sonarium.operators import search as se
from sonarium.operators import state as st
from sonarium.operators.index import remove_index
from sonarium.plans.registry import QUERIES, SQL, query
from sonarium.sources import tables as tb
from sonarium.sources.tables import spread, table
from sonarium.streaming import feed
from sonarium.streaming import limits as lm

__all__ = ["QUERIES", "SQL"]


def word_hashes(text: str = "text") -> F.Column:
    """A text as a fingerprint: 32-bit hashes of its words, which are runs of a-z and 0-9."""
    return fp.word_hashes(F.lower(F.col(text)))


def fingerprints(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """id and hashes; a scan of few splits is spread, as each row is much work."""
    return spread(table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")).select("id", word_hashes().alias("hashes"))


_HASHES = "list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT)"
_UUID = "substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(u, 17, 1))::BIGINT % 4 AS INT) + 1, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12)"
_TERMS = f"""d AS (SELECT doc_id, {_HASHES} AS h FROM documents),
e AS (SELECT doc_id, unnest(h[greatest(0, least(len(h) - 120, 80)) + 1:]) AS v, generate_subscripts(h[greatest(0, least(len(h) - 120, 80)) + 1:], 1) AS i FROM d),
g AS (SELECT doc_id, v - v % 16 AS term, min(i) AS i FROM e GROUP BY 1, 2),
t AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g)"""


@query("o021_query_terms", f"WITH {_TERMS} SELECT doc_id AS id, term FROM t WHERE n <= 120")
def query_terms(spark, sf_dir):
    return se.term_index(fingerprints(spark, sf_dir, "documents", "doc_id"))


_SIMHASH = "CAST(list_sum(list_transform(range(32), lambda b: CASE WHEN 2 * len(list_filter(h, lambda x: (x >> b) & 1 = 1)) > len(h) THEN 1::BIGINT << b ELSE 0 END)) AS BIGINT)"


@query("o022_simhash", f"WITH d AS (SELECT doc_id, {_HASHES} AS h FROM documents) SELECT doc_id AS id, {_SIMHASH} AS simhash FROM d")
def simhashes(spark, sf_dir):
    return fingerprints(spark, sf_dir, "documents", "doc_id").select("id", fp.simhash("hashes").alias("simhash"))


@query("o029_codec_round_trip", f"WITH d AS (SELECT doc_id, {_HASHES} AS h FROM documents), s AS (SELECT doc_id, md5(array_to_string(list_transform(h, lambda x: CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END), ',')) AS m FROM d) SELECT doc_id AS id, m AS from_text, m AS from_binary FROM s")
def codec(spark, sf_dir):
    """What comes back from the compact text, and from the compressed binary form."""
    digest = lambda h: F.md5(F.array_join(h, ","))
    rows = fingerprints(spark, sf_dir, "documents", "doc_id")
    return rows.select("id", digest(fp.decode_text(fp.encode_text("hashes"))).alias("from_text"), digest(fp.decompress(fp.compress("hashes"))).alias("from_binary"))


@query("o028_text_form", """WITH h AS (SELECT item_id, CAST(i AS BIGINT) AS a, CAST((item_id * 977 + i * 13) % 4096 AS BIGINT) AS b FROM benchmark, range(1, 4) t(i)) SELECT item_id AS id, 1 AS version, CAST(3 AS BIGINT) AS n, list(b ORDER BY a) AS hashes FROM h GROUP BY 1""")
def text_form(spark, sf_dir):
    """Version and number of hashes as the text form's first four bytes say, and the hashes that are read back."""
    k = F.col("item_id")
    hashes = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda i: ((k * 977 + i * 13) % 4096).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select(k.alias("id"), fp.encode_text(hashes).alias("text"))
    head = F.hex(F.unbase64(F.translate(F.substring("text", 1, 4), "-_", "+/")))
    more = F.hex(F.unbase64(F.concat(F.translate(F.substring("text", 5, 2), "-_", "+/"), F.lit("=="))))
    return rows.select("id", F.conv(F.substring(head, 1, 2), 16, 10).cast("int").alias("version"), F.conv(F.concat(F.substring(head, 3, 4), more), 16, 10).cast("long").alias("n"), fp.decode_text("text").cast("array<bigint>").alias("hashes"))


@query("o025_processed", f"WITH d AS (SELECT item_id, {_HASHES} AS h FROM benchmark), b AS (SELECT item_id, h, sha1(unhex('df7bef46416e4c57a87739b54325ef03' || '01000000' || array_to_string(list_transform(list_transform(h, lambda x: printf('%08x', x)), lambda x: substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)), ''))) AS u FROM d) SELECT item_id AS id, len(h) AS n, {_UUID} AS gid, {_SIMHASH} AS simhash FROM b")
def processed(spark, sf_dir):
    rows = fingerprints(spark, sf_dir, "benchmark", "item_id").select("id", fp.processed(fp.encode_text("hashes")).alias("p"))
    return rows.select("id", F.size("p.hashes").cast("long").alias("n"), "p.gid", "p.simhash")


@query("o034_overlap", f"WITH d AS (SELECT item_id, {_HASHES} AS h FROM benchmark) SELECT a.item_id AS id, list_has_any(a.h, b.h) AS shared, a.h[6:10] AS part, len(a.h) AS n FROM d a JOIN d b ON b.item_id = a.item_id + 1")
def overlap(spark, sf_dir):
    rows = fingerprints(spark, sf_dir, "benchmark", "item_id")
    after = rows.select((F.col("id") - 1).alias("id"), F.col("hashes").alias("next"))
    return rows.join(after, "id").select("id", fp.overlaps("hashes", "next").alias("shared"), fp.to_unsigned(fp.subarray("hashes", 5, 5)).alias("part"), F.size("hashes").cast("long").alias("n"))


@query("o035_difference", f"WITH d AS (SELECT item_id, {_HASHES} AS h FROM benchmark), p AS (SELECT a.item_id, a.h[3:] AS a, b.h AS b FROM d a JOIN d b ON b.item_id = a.item_id + 1) SELECT item_id AS id, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: xor(a[i], b[i])) AS bits FROM p")
def difference(spark, sf_dir):
    rows = fingerprints(spark, sf_dir, "benchmark", "item_id")
    after = rows.select((F.col("id") - 1).alias("id"), F.col("hashes").alias("next"))
    return rows.join(after, "id").select("id", fp.to_unsigned(fp.xor_at(F.col("hashes"), F.col("next"), 2)).alias("bits"))


@query("o031_literals", f"WITH d AS (SELECT item_id, {_HASHES} AS h FROM benchmark) SELECT item_id AS id, list_transform(h, lambda x: CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) AS hashes FROM d")
def literals(spark, sf_dir):
    rows = fingerprints(spark, sf_dir, "benchmark", "item_id")
    text = F.concat(F.lit("{"), F.array_join("hashes", ","), F.lit("}"))
    return rows.select("id", fp.parse_array(text).cast("array<bigint>").alias("hashes"))


@query("o023_shingled_simhash", f"WITH d AS (SELECT item_id, {_HASHES} AS h FROM benchmark), w AS (SELECT item_id, unnest(range(0, CAST(len(h) AS BIGINT), 90)) AS i, h FROM d), v AS (SELECT item_id, i, h[i + 1 : i + 120] AS h FROM w), s AS (SELECT item_id, i, CAST(list_sum(list_transform(range(32), lambda b: CASE WHEN 2 * len(list_filter(h, lambda x: (x >> b) & 1 = 1)) > len(h) THEN 1::BIGINT << b ELSE 0 END)) AS BIGINT) AS s FROM v) SELECT item_id AS id, coalesce(list(s ORDER BY i) FILTER (WHERE s IS NOT NULL), []) AS simhashes FROM benchmark LEFT JOIN s USING (item_id) GROUP BY item_id")
def shingled(spark, sf_dir):
    return fingerprints(spark, sf_dir, "benchmark", "item_id").select("id", fp.shingled_simhash(F.col("hashes"), 120, 90).alias("simhashes"))


@query("o024_content_id", f"WITH d AS (SELECT doc_id, list_transform({_HASHES}, lambda x: printf('%08x', x)) AS h FROM documents), b AS (SELECT doc_id, sha1(unhex('df7bef46416e4c57a87739b54325ef03' || '01000000' || array_to_string(list_transform(h, lambda x: substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)), ''))) AS u FROM d) SELECT doc_id AS id, {_UUID} AS gid FROM b")
def content_ids(spark, sf_dir):
    return fingerprints(spark, sf_dir, "documents", "doc_id").select("id", fp.content_id(F.col("hashes")).alias("gid"))


_CANDIDATES = f"""WITH {_TERMS}, c AS (SELECT DISTINCT doc_id, x - x % 16 AS term FROM (SELECT doc_id, unnest(h) AS x FROM d)),
qh AS (SELECT item_id, {_HASHES} AS h FROM benchmark), q AS (SELECT DISTINCT item_id, x - x % 16 AS term FROM (SELECT item_id, unnest(h) AS x FROM qh)),
m AS (SELECT item_id, doc_id, count(*) AS matches FROM q JOIN c USING (term) GROUP BY 1, 2),
r AS (SELECT *, max(matches) OVER (PARTITION BY item_id) AS best, row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, doc_id) AS place FROM m)
SELECT item_id AS query_id, doc_id AS id, matches FROM r WHERE matches * 100 > best * 10 AND place <= 20"""


@query("o036_candidates", _CANDIDATES)
def find_candidates(spark, sf_dir):
    """Items among documents, over a stored index."""
    return indexed_candidates(spark, sf_dir, lambda n: se.COMMON)


@query("o036b_common_terms", _CANDIDATES)
def bounded_candidates(spark, sf_dir):
    """The same with terms held back that are in more than a tenth of the documents."""
    return indexed_candidates(spark, sf_dir, lambda n: n // 10)


def indexed_candidates(spark, sf_dir, common):
    asked = fingerprints(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("id", "query_id")
    with tb.Scratch(spark) as scratch:
        corpus = fingerprints(spark, sf_dir, "documents", "doc_id")
        index = se.empty_index(spark, buckets=8).updated(corpus)
        found = se.candidates(se.term_index(asked, "query_id", every_term=True), index, common=common(corpus.count()))
        found = scratch.keep(found, "found", outlive=True)
        remove_index(index)
    return found


@query("o100_fix_meta", "SELECT page_id, regexp_replace(html, '[ \\t\\n\\r\\f\\v\\x00\\x1c-\\x1f]+', ' ', 'g') AS html FROM pages")
def fixed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.fix_text(F.col("html")).alias("html"))


@query("o101_meta_id", f"WITH b AS (SELECT doc_id, sha1(unhex('3b3bd2285d2c11eab49860f67731bf41') || encode('{{\"track\":\"' || lang || '\",\"artist\":\"' || source || '\"}}')) AS u FROM documents) SELECT doc_id, {_UUID} AS gid FROM b")
def meta_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.meta_id(track=F.col("lang"), artist=F.col("source")).alias("gid"))


@query("o114_add_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def upserts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.lit(1).cast("long").alias("n"), "event_id")
    half = [events.where(c).groupBy("user_id", "event_type").agg(F.count("*").alias("n")) for c in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return st.add_counts(*half, ["user_id", "event_type"], ["n"])


@query("o125_keep_first", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def first_of_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return st.keep_first(docs, "content", "doc_id")


@query("o145_latest_change", "SELECT user_id, max(event_id) AS id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_changes(spark, sf_dir):
    return feed.latest(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type"), "user_id")


@query("o016_xml", "SELECT n_nationkey, '<nation id=\"' || n_nationkey || '\"><name>' || n_name || '</name><parts><part>1</part><part>2</part></parts></nation>' AS xml FROM nation")
def nations_as_xml(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_nationkey").alias("@id"), F.col("n_name").alias("name"), F.array(F.lit(1), F.lit(2)).alias("parts")).alias("r"))
    return rows.select("n_nationkey", tb.xml(F.col("r"), "nation", rows.schema["r"].dataType).alias("xml"))


#: Buckets of five seconds of a key, in their order; what the last three accepted is carried along.
_LIMITED = """WITH RECURSIVE h AS (SELECT event_type AS k, CAST(floor(epoch(ts)) AS BIGINT) // 5 * 5 AS bucket, count(*) AS hits FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bucket) AS i FROM h),
r AS (
  SELECT k, i, bucket, hits, least(hits, 2) AS accepted, -1000::BIGINT AS b1, 0::BIGINT AS a1, -1000::BIGINT AS b2, 0::BIGINT AS a2 FROM n WHERE i = 1
  UNION ALL SELECT n.k, n.i, n.bucket, n.hits, least(n.hits, greatest(0, 2 - CASE WHEN r.bucket > n.bucket - 20 THEN r.accepted ELSE 0 END
    - CASE WHEN r.b1 > n.bucket - 20 THEN r.a1 ELSE 0 END - CASE WHEN r.b2 > n.bucket - 20 THEN r.a2 ELSE 0 END)), r.bucket, r.accepted, r.b1, r.a1
  FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
SELECT k AS {0}, bucket, hits, accepted FROM r"""


@query("o086_limited", _LIMITED.format("event_type"))
def limits(spark, sf_dir):
    return rq.limited(table(spark, sf_dir, "events"), "event_type", "ts", 0.1)


@query("o086b_limited_stream", _LIMITED.format("key"))
def limits_of_a_stream(spark, sf_dir):
    """The same of the events as a stream, with state of a window a key and timers; one hit of a day later lets the watermark pass all others."""
    out = tb.shared_folder(spark, "limited")
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    before = spark.conf.get(lm.STORE[0], None)
    spark.conf.set(*lm.STORE)
    with tb.Scratch(spark) as scratch:
        try:
            end = tb.shared_folder(spark, "end")
            scratch.paths += [end, f"{out}/checkpoint"]
            events.agg(F.lit("end").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).write.parquet(end)
            files = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(events_folder(spark, sf_dir, scratch))
            hits = files.select("event_type", F.col("ts").cast("timestamp").alias("ts")).unionByName(spark.readStream.schema(events.schema).parquet(end))
            limited = lm.limited_stream(hits, "event_type", "ts", 0.1)
            limited.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(lm.STORE[0], before) if before else spark.conf.unset(lm.STORE[0])
    return spark.read.schema("key STRING, bucket LONG, hits LONG, accepted LONG").parquet(f"{out}/rows")


def events_folder(spark, sf_dir, scratch):
    """A folder with the events alone, as files of a stream."""
    path = tb.shared_folder(spark, "events")
    scratch.paths.append(path)
    table(spark, sf_dir, "events").write.parquet(path)
    return path


@query("o092_meta_dispatch", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'recordings' WHEN 2 THEN 'm2' ELSE 'releasegroups' END AS kind FROM events")
def dispatch(spark, sf_dir):
    meta = F.element_at(F.array(*map(F.lit, ("0", "1", "2", "releases\treleasegroupids "))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", rq.document_kind(rq.wanted(meta)).alias("kind"))


@query("o103_foreign_parts", "SELECT c_custkey, 'customer' AS vendor, 'x:' || c_name AS name FROM customer")
def foreign(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.foreign_parts(F.concat(F.lit("customer:x:"), "c_name")).alias("f")).select("c_custkey", "f.*")


@query("o112_name_scores", """WITH n AS (SELECT p_brand, p_partkey, p_size AS w, regexp_replace(lower(p_name), '[ \\t\\n\\r]+', '', 'g') AS s FROM part),
g AS (SELECT DISTINCT p_brand, p_partkey, w, substr(s, i, 4) AS gram FROM (SELECT *, unnest(range(1, CAST(length(s) AS BIGINT) - 2)) AS i FROM n)),
t AS (SELECT p_brand, gram, sum(w) AS w FROM g GROUP BY 1, 2), a AS (SELECT p_brand, sum(w) AS total FROM t GROUP BY 1)
SELECT p_brand, p_partkey, round(CAST(sum(t.w) AS DOUBLE) / any_value(total), 6) AS score FROM g JOIN t USING (p_brand, gram) JOIN a USING (p_brand) GROUP BY 1, 2""")
def name_scores(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("weight"))
    return cl.name_scores(names, "p_brand", "p_partkey").select("p_brand", "p_partkey", F.round("score", 6).alias("score"))


@query("o124_canonical", "SELECT doc_id AS id, coalesce(min(CASE WHEN doc_id % 3 = 0 THEN doc_id END) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text)) AS canonical FROM documents")
def canonical(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content"), F.when(F.col("doc_id") % 3 == 0, "g").alias("gid"))
    return st.canonical(docs)


@query("o131_joinable", "SELECT o_custkey AS query_id, o_orderstatus AS track FROM orders GROUP BY 1, 2 HAVING bool_and(o_orderkey % 10 >= 4 AND o_orderkey % 9 <= 7)")
def joinable(spark, sf_dir):
    k = F.col("o_orderkey")
    return cl.joinable(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("track"), (k % 10 / 10.0).alias("score"), (k % 9).alias("length_diff")))


@query("o136_fan_out", "SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] ELSE [NULL] END) AS mbid FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def fan_out(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("mbids"), none.alias("puid"), none.alias("foreign_id"), F.when(k % 3 == 0, "m").alias("meta"))
    return rq.fan_out(rows).select("o_orderkey", "mbid")


@query("o146_queue", "SELECT event_id AS id FROM events WHERE event_type <> 'error' ORDER BY event_id LIMIT 100")
def queued(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return rq.take_queued(ids.select("id"), ids.where("event_type = 'error'"), 100)


@query("o148_drain", "SELECT user_id, event_type, CAST(count(*) - count(*) FILTER (WHERE event_id % 2 = 0) AS BIGINT) AS n FROM events WHERE user_id % 5 > 0 GROUP BY 1, 2 HAVING count(*) > count(*) FILTER (WHERE event_id % 2 = 0)")
def drained(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    count = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return st.drain(count(events), count(events.where("event_id % 2 = 0")), ["user_id", "event_type"], events.where("user_id % 5 > 0"), "user_id")


@query("o153_rate_policy", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'application' WHEN event_id % 3 = 0 THEN 'global' WHEN event_id % 4 > 0 AND event_id % 2 = 0 THEN 'address' END AS refused FROM events")
def policy(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", rq.refused_by(k % 5 != 0, k % 3 != 0, k % 2 != 0, F.when(k % 4 == 0, 10), k % 11 == 0).alias("refused"))


# The other modules register theirs when they are loaded; some take fingerprints from here.
from sonarium.plans import changes, documents, figures, relations  # noqa: E402, F401
