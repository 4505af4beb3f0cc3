"""Queries of changes: upserts, merges, switches, watermarks, feeds, queues, and the import of submissions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sonarium.functions import text as tx
from sonarium.operators import clusters as cl
from sonarium.operators import imports as im
from sonarium.operators import links as lk
from sonarium.operators import requests as rq
from sonarium.operators import search as se
from sonarium.operators import state as st
from sonarium.operators.index import remove_index
from sonarium.plans.catalogue import _HASHES, _TERMS, _UUID, fingerprints, word_hashes
from sonarium.plans.registry import query
from sonarium.sources import tables as tb
from sonarium.sources.tables import table
from sonarium.streaming import changes as ch
from sonarium.streaming import feed
from sonarium.streaming import log as lg

c = F.col


def links_of_parts(spark, sf_dir):
    """Parts as links: brand is the item, a number below 100 the track."""
    part = table(spark, sf_dir, "part")
    k = c("p_partkey")
    return part.select(k.alias("id"), (k % 100).alias("track_id"), c("p_brand").alias("item"), c("p_size").cast("long").alias("submission_count"), (c("p_size") > 10).alias("disabled"), F.lit(None).cast("long").alias("merged_into"))


@query(
    "o116_find_or_insert",
    """SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY c_name), c_name FROM customer WHERE c_custkey % 2 = 1""",
)
def find_or_insert(spark, sf_dir):
    """Even customers are there with ids of their own; asked for are all, twice."""
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    return st.find_or_insert(rows.where("id % 2 = 0"), rows.unionByName(rows).select("name"), ["name"])


@query("o117_links", "WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 > 0 AND user_id % 4 > 0 GROUP BY 1, 2), d AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) SELECT coalesce(s.user_id, d.user_id) AS track_id, coalesce(s.event_type, d.event_type) AS item, coalesce(s.n, 0) + coalesce(d.n, 0) AS submission_count, coalesce(d.n, 0) AS provenance FROM s FULL JOIN d ON s.user_id = d.user_id AND s.event_type = d.event_type")
def upserted(spark, sf_dir):
    """Links with the provenance rows that a batch of events added to each."""
    events = table(spark, sf_dir, "events").select(c("user_id").alias("track_id"), c("event_type").alias("item"), c("event_id").alias("submission_id"), F.lit(1).cast("long").alias("source_id"))
    old = events.where("submission_id % 3 > 0 and track_id % 4 > 0").groupBy("track_id", "item").agg(F.count("*").alias("submission_count"))
    state = st.numbered(old, ["track_id", "item"]).select(c("n").alias("id"), "track_id", "item", "submission_count")
    after, provenance = lk.upserted(state, events.where("submission_id % 3 = 0"), "item")
    counts = provenance.groupBy(c("link_id").alias("id")).agg(F.count("*").alias("provenance"))
    return after.join(counts, "id", "left").select("track_id", "item", "submission_count", F.coalesce("provenance", F.lit(0)).alias("provenance"))


@query("o118_merge_item", "WITH l AS (SELECT p_partkey % 20 AS t, p_brand AS item, sum(p_size) AS n, bool_and(p_size > 10) AS off FROM part GROUP BY 1, 2), s AS (SELECT * FROM l WHERE item = 'Brand#11'), g AS (SELECT * FROM l WHERE item = 'Brand#12') SELECT t AS track_id, item, CAST(n AS BIGINT) AS submission_count, off AS disabled, false AS merged FROM l WHERE item NOT IN ('Brand#11', 'Brand#12') UNION ALL SELECT t, 'Brand#11', 0, true, true FROM s UNION ALL SELECT coalesce(s.t, g.t), 'Brand#12', CAST(coalesce(s.n, 0) + coalesce(g.n, 0) AS BIGINT), coalesce(g.off, false) AND coalesce(s.off, true), false FROM s FULL JOIN g USING (t)")
def merge_item(spark, sf_dir):
    links = links_of_parts(spark, sf_dir).groupBy((c("id") % 20).alias("track_id"), "item").agg(F.min("id").alias("id"), F.sum("submission_count").alias("submission_count"), F.bool_and("disabled").alias("disabled")).withColumn("merged_into", F.lit(None).cast("long"))
    after, _ = lk.merged_item(links, "Brand#11", "Brand#12", "item")
    return after.select("track_id", "item", "submission_count", "disabled", c("merged_into").isNotNull().alias("merged"))


@query("o121_disable", "SELECT p_partkey AS id, p_size > 10 OR p_brand IN ('Brand#11', 'Brand#12') AS disabled, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'gone' END AS note FROM part")
def disable(spark, sf_dir):
    links = links_of_parts(spark, sf_dir)
    after, audit = lk.disabled(links, spark.createDataFrame([("Brand#11",), ("Brand#12",)], "item string"), "item", "gone", 7)
    return after.join(audit.select(c("link_id").alias("id"), "note"), "id", "left").select("id", "disabled", "note")


_MERGED = "WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 100 < 60 THEN p_partkey % 10 ELSE p_partkey % 100 END AS t, p_brand AS item, p_size AS n, p_size > 10 AS off FROM part)"


def merged_tables(spark, sf_dir) -> lk.TrackTables:
    """Tracks 10 to 59 are merged, each into the one ten below, so that all end up in 0 to 9."""
    links = links_of_parts(spark, sf_dir)
    sources = spark.range(10, 60).select(c("id").alias("track_id"), (c("id") - 10).alias("target"))
    provenance = links.select(c("id").alias("link_id"))
    tables = lk.TrackTables({"item": links}, {"item": provenance}, provenance.where("false"), links.select("id", "track_id"), spark.range(100).select("id", F.lit(None).cast("long").alias("new_id")))
    return lk.merged_tracks(tables, sources, "item")


@query("o122_merge_tracks", f"{_MERGED} SELECT min(id) AS id, t AS track_id, item, CAST(sum(n) AS BIGINT) AS submission_count, bool_and(off) AS disabled, count(*) AS provenance FROM m WHERE t < 10 GROUP BY t, item UNION ALL SELECT id, t, item, n, off, 1 FROM m WHERE t >= 10")
def merge_tracks(spark, sf_dir):
    """Chains of merges in one step: links with the provenance of each."""
    after = merged_tables(spark, sf_dir)
    counts = after.provenance["item"].groupBy(c("link_id").alias("id")).agg(F.count("*").alias("provenance"))
    return after.links["item"].join(counts, "id").select("id", "track_id", "item", "submission_count", "disabled", "provenance")


@query("o122b_merged_ends", f"{_MERGED} SELECT i AS id, CASE WHEN i BETWEEN 10 AND 59 THEN i % 10 END AS new_id, (SELECT count(*) FROM m WHERE t = i) AS fingerprints FROM range(100) r(i)")
def merged_ends(spark, sf_dir):
    """Where the tracks of the same merges lead, and the fingerprints that they hold then."""
    after = merged_tables(spark, sf_dir)
    held = after.fingerprints.groupBy(c("track_id").alias("id")).agg(F.count("*").alias("n"))
    return after.tracks.join(held, "id", "left").select("id", "new_id", F.coalesce("n", F.lit(0)).alias("fingerprints"))


@query("o123_toggle", "SELECT p_partkey AS id, (p_size > 10) <> (p_partkey % 7 = 0) AS disabled FROM part")
def toggle(spark, sf_dir):
    links = links_of_parts(spark, sf_dir)
    return lk.toggled(links, links.where("id % 7 = 0"), "by hand")[0].select("id", "disabled")


@query("o119_missing", "SELECT p_partkey AS item, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 1 END AS target, CASE WHEN p_partkey % 5 = 0 THEN 'merged' WHEN p_partkey % 5 = 1 THEN 'kept' WHEN p_partkey % 5 = 2 THEN 'expired' ELSE 'unknown' END AS outcome FROM part WHERE p_partkey % 2 = 0")
def missing(spark, sf_dir):
    k = c("p_partkey")
    links = table(spark, sf_dir, "part").select(k.alias("item"))
    of = lambda n: links.where(f"item % 5 = {n}")
    unknown = of(2).select("item", F.lit("2024-01-01").alias("unknown_since")).unionByName(of(3).select("item", F.lit("2024-01-09").alias("unknown_since")))
    found = lk.follow_missing(links, links.where("item % 2 = 0"), of(0).select("item", (c("item") + 1).alias("target")), of(1), unknown, F.to_date(F.lit("2024-01-10")), "item")
    return found.select("item", "target", "outcome")


@query("o126_forward", "SELECT 'behind' AS name, max(event_id) AS position FROM events UNION ALL SELECT 'ahead', max(event_id) + 5 FROM events")
def forward(spark, sf_dir):
    newest = table(spark, sf_dir, "events").agg(F.max("event_id").alias("position"))
    behind = st.forward(newest.select((c("position") - 5).alias("position")), newest, "position")
    ahead = st.forward(newest.select((c("position") + 5).alias("position")), newest, "position")
    return behind.select(F.lit("behind").alias("name"), "position").unionByName(ahead.select(F.lit("ahead").alias("name"), "position"))


@query("o104_counter_keys", "SELECT p_partkey, replace(url_encode(p_name), '%2F', '/') || ':a%3Ab/c%25:' || replace(url_encode(p_brand), '%2F', '/') AS key, p_name AS name, 'a:b/c%' AS odd FROM part")
def counter_keys(spark, sf_dir):
    key = tx.counter_key(c("p_name"), F.lit("a:b/c%"), c("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), tx.counter_part(key, 0).alias("name"), tx.counter_part(key, 1).alias("odd"))


@query("o109_lock_shard")
def locks(spark, sf_dir):
    """Tested against the same sums in Python."""
    return table(spark, sf_dir, "customer").select("c_custkey", tx.lock_id(c("c_name")).alias("lock"), tx.shard(c("c_name")).alias("shard"))


@query("o017_counters", "SELECT substr(CAST(ts AS VARCHAR), 1, 10) || ':' || substr(CAST(ts AS VARCHAR), 12, 2) || ':' || user_id || ':' || event_type AS key, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf_dir):
    """Counters as they stand in their shards, brought together by key."""
    key = tx.counter_key(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH"), c("user_id"), c("event_type"))
    shards = table(spark, sf_dir, "events").select(key.alias("key")).groupBy(tx.shard(c("key")).alias("shard"), "key").agg(F.count("*").alias("n"))
    return shards.select("key", "n")


@query("o099_validation", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing client' WHEN o_orderkey % 11 = 0 THEN 'missing user' WHEN o_custkey % 50 = 0 THEN 'invalid duration' WHEN o_orderkey % 5 = 0 THEN 'invalid bitrate' WHEN o_orderkey % 3 = 0 THEN 'invalid uuid' WHEN o_orderkey % 2 = 0 THEN 'invalid foreign id' END AS error FROM orders")
def validation(spark, sf_dir):
    k, none = c("o_orderkey"), F.lit(None).cast("string")
    asked = table(spark, sf_dir, "orders").select(k, F.when(k % 7 != 0, "key").alias("client"), F.when(k % 11 != 0, "key").alias("user"), (c("o_custkey") % 50).alias("duration"), F.when(k % 5 == 0, 0).alias("bitrate"), F.when(k % 3 == 0, "no").otherwise(none).alias("mbid"), F.when(k % 2 == 0, "no").otherwise("a:b").alias("foreign_id"))
    return rq.validated(asked).select("o_orderkey", "error")


@query(
    "o099b_lookup_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 40 WHEN o_orderkey % 5 = 1 THEN 12 ELSE 7 END AS band,
  (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 > 0)::INT AS good, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid maxdurationdiff' WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'missing duration' END AS error FROM orders""",
)
def lookup_errors(spark, sf_dir):
    """Lookups of two parts, of which some are bad: how many are good, the length band, and the error of the whole."""
    k = c("o_orderkey")
    u = "b81f83ee-4da4-11e0-9ed8-0025225356f3"
    pairs = [("trackid.1", F.when(k % 2 == 0, u).otherwise("u")), ("fingerprint.2", F.lit("AQ")), ("duration.2", F.when(k % 3 > 0, "9").otherwise("none")), ("maxdurationdiff", F.when(k % 5 == 0, "40").when(k % 5 == 1, "12").otherwise("x"))]
    params = F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])
    held = table(spark, sf_dir, "orders").select(k, rq.lookup_request(params).alias("r"))
    return held.select(k, "r.band", F.size(F.filter("r.queries", lambda q: q["error"].isNull())).alias("good"), "r.error")


@query(
    "o133_merge_groups",
    """WITH RECURSIVE p AS (SELECT p_partkey AS b, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey - 1 ELSE p_partkey - 3 END AS a FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 4 = 0),
f AS (SELECT b AS track, a AS led FROM p UNION ALL SELECT track, a FROM f JOIN p ON b = led),
g AS (SELECT track, min(led) AS "group" FROM f GROUP BY track)
SELECT track, "group" FROM g UNION SELECT "group", "group" FROM g""",
)
def merge_groups(spark, sf_dir):
    """Parts pair with the one before, but for every fifth, and every fourth with the one three before."""
    k = c("p_partkey")
    part = table(spark, sf_dir, "part")
    pairs = part.where(k % 5 != 0).select((k - 1).alias("a"), k.alias("b")).unionByName(part.where(k % 4 == 0).select((k - 3).alias("a"), k.alias("b")))
    return cl.merge_groups(pairs)


@query("o130_gate", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'nothing named' WHEN o_orderkey % 3 = 0 THEN 'too few hashes' WHEN o_orderkey % 7 = 0 THEN 'nothing to index' END AS refused FROM orders")
def gate(spark, sf_dir):
    """Ids of zeros name nothing; silence cannot be indexed, were there enough of it."""
    k, none = c("o_orderkey"), F.lit(None).cast("string")
    long, short = F.sequence(F.lit(1), F.lit(80)), F.sequence(F.lit(1), F.lit(79))
    hashes = F.when(k % 3 == 0, short).otherwise(long)
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 8 == 4, cl.ZERO_ID).alias("mbid"), F.when(k % 8 == 0, cl.ZERO_ID).alias("puid"), F.when(k % 4 > 0, "m").otherwise(none).alias("meta"), hashes.alias("hashes"))
    gated = cl.gated(rows.where("id % 3 = 0 or id % 4 = 0 or id % 7 > 0"))
    silent = rows.where("id % 3 > 0 and id % 4 > 0 and id % 7 = 0").select("id", F.lit("nothing to index").alias("refused"))
    return gated.select("id", "refused").unionByName(silent)


@query("o132_assign", "WITH m AS (SELECT o_custkey AS q, o_orderkey AS id, o_orderkey % 7 AS track, (o_orderkey % 100) / 100.0E0 AS score FROM orders), a AS (SELECT * FROM m WHERE score > 0.75 AND track <> 3), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS n FROM a) SELECT q AS query_id, track, CASE WHEN score > 0.9 THEN id END AS id FROM r WHERE n = 1")
def assign(spark, sf_dir):
    k = c("o_orderkey")
    matches = table(spark, sf_dir, "orders").select(c("o_custkey").alias("query_id"), k.alias("id"), (k % 7).alias("track"), (k % 100 / 100.0).alias("score"))
    return cl.assign(matches, matches.where("track <> 3").select("query_id", "track").distinct())


@query(
    "o135_results",
    f"""WITH d AS (SELECT doc_id, lang, source, n_chars, {_HASHES} AS h FROM documents),
k AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '{{"track":"' || lang || '","artist":"' || source || '"' || CASE WHEN n_chars <= 10000 AND n_chars > 0 THEN ',"track_no":' || n_chars ELSE '' END || '}}' END AS meta,
  CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'v' || doc_id % 3 END AS version FROM d WHERE len(list_distinct(h)) >= 80 AND doc_id % 11 <> 5 AND (doc_id % 4 = 0 OR doc_id % 3 > 0)),
g AS (SELECT *, CASE WHEN meta IS NOT NULL THEN {_UUID.replace("u,", "sha1(unhex('3b3bd2285d2c11eab49860f67731bf41') || encode(meta)),")} END AS gid FROM k),
m AS (SELECT gid, row_number() OVER (ORDER BY gid) AS meta_id FROM g WHERE gid IS NOT NULL GROUP BY gid),
f AS (SELECT name, row_number() OVER (ORDER BY name) AS format_id FROM (SELECT DISTINCT 'F' || doc_id % 5 AS name FROM k))
SELECT doc_id AS submission_id, row_number() OVER (ORDER BY doc_id) AS fingerprint_id, row_number() OVER (ORDER BY doc_id) AS track_id, doc_id % 5 AS account_id, doc_id % 7 AS application_id,
  version AS application_version, m.meta_id, gid AS meta_gid, CASE WHEN doc_id % 3 > 0 THEN 'm' || doc_id % 50 END AS mbid, CASE WHEN doc_id % 6 = 1 THEN 'v:' || doc_id % 9 END AS foreignid,
  CAST(n_chars % 320 AS INT) AS bitrate, f.format_id, '2024-01-02 03:04:05' AS handled
FROM g LEFT JOIN m USING (gid) JOIN f ON name = 'F' || doc_id % 5""",
)
def results(spark, sf_dir):
    """One round of all documents into an empty store, line by line: new tracks and fingerprints, accounts, formats, metadata put in order, foreign ids that are none left out."""
    k, n = c("doc_id"), c("n_chars")
    docs = tb.spread(table(spark, sf_dir, "documents").select(k, "text", "lang", "source", n)).select(k.alias("id"), k, "lang", "source", n, word_hashes().alias("hashes"))
    none = F.lit(None).cast("string")
    number = F.lit(None).cast("int")
    meta = F.struct(c("lang").alias("track"), c("source").alias("artist"), F.lit("").alias("album"), none.alias("album_artist"), n.cast("int").alias("track_no"), number.alias("disc_no"), number.alias("year"))
    asked = docs.select(
        "id", "hashes", F.size("hashes").alias("length"), (n % 320).alias("bitrate"), F.concat(F.lit("F"), (k % 5).cast("string")).alias("format"), F.when(k % 11 == 5, 77).alias("source_id"),
        (k % 7).alias("application_id"), (k % 5).alias("account_id"), F.when(k % 2 == 1, F.concat(F.lit("v"), (k % 3).cast("string"))).alias("application_version"),
        F.when(k % 3 > 0, F.concat(F.lit("m"), (k % 50).cast("string"))).alias("mbid"), F.when(k % 3 == 0, cl.ZERO_ID).alias("puid"), F.when(k % 4 == 0, meta).alias("meta"),
        F.when(k % 6 == 1, F.concat(F.lit("v:"), (k % 9).cast("string"))).when(k % 6 == 2, "none").alias("foreignid"),
    )
    after = im.import_round(im.empty_state(spark), asked, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    prints = after.fingerprints.select(c("id").alias("fingerprint_id"), "bitrate", "format_id")
    rows = after.results.join(prints, "fingerprint_id")
    names = ["submission_id", "fingerprint_id", "track_id", "account_id", "application_id", "application_version", "meta_id", "meta_gid", "mbid", "foreignid", "bitrate", "format_id"]
    return rows.select(*names, F.date_format("handled_at", "yyyy-MM-dd HH:mm:ss").alias("handled"))


@query(
    "o140_capture",
    f"""WITH {_TERMS}, q AS (SELECT doc_id, string_agg(term, ',' ORDER BY n) AS q FROM t WHERE n <= 120 GROUP BY 1)
SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY doc_id) AS id, doc_id AS fingerprint_id, coalesce(q, '') AS query FROM documents LEFT JOIN q USING (doc_id)""",
)
def capture(spark, sf_dir):
    """The positions that new documents get behind a log, with their query terms."""
    log = table(spark, sf_dir, "events").select(c("event_id").alias("id"), c("user_id").alias("fingerprint_id"), F.array().cast("array<bigint>").alias("query"))
    top = log.agg(F.max("id").alias("top"))
    after = feed.captured(log, fingerprints(spark, sf_dir, "documents", "doc_id"))
    return after.join(F.broadcast(top)).where("id > top").select("id", "fingerprint_id", F.array_join("query", ",").alias("query"))


@query("o141_changes", "SELECT event_id AS id, user_id, event_type FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 100")
def changes(spark, sf_dir):
    return feed.read_changes(table(spark, sf_dir, "events").select(c("event_id").alias("id"), "user_id", "event_type"), 200, 100, floor=200)


@query("o143_bootstrap", "SELECT user_id, max(event_id) AS id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def bootstrapped(spark, sf_dir):
    """A snapshot of the first rows, brought up to date, is the state of the whole."""
    log = table(spark, sf_dir, "events").select(c("event_id").alias("id"), "user_id", "event_type")
    return feed.bootstrap(feed.latest(log.where("id <= 300"), "user_id").select("user_id", "id", "event_type"), log, "user_id", 300)


@query("o143b_chunks", f"WITH {_TERMS} SELECT CAST(doc_id // 64 AS BIGINT) AS chunk, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE n <= 120) AS terms FROM t GROUP BY 1")
def chunks(spark, sf_dir):
    rows = feed.bootstrap_rows(fingerprints(spark, sf_dir, "documents", "doc_id"), 64)
    return rows.groupBy("chunk").agg(F.count("*").alias("documents"), F.sum(F.size("terms")).alias("terms"))


@query("o007_changes", "SELECT o_custkey AS id, max(o_orderkey) AS lsn, arg_max(CASE o_orderkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END, o_orderkey) AS action, CASE WHEN max(o_orderkey) % 3 < 2 THEN '-' || max(o_orderkey) || ',7' END AS hashes FROM orders GROUP BY 1")
def row_changes(spark, sf_dir):
    """Lines of changes are decoded, and the last one of each id is kept."""
    k = c("o_orderkey")
    action = F.element_at(F.array(F.lit("I"), F.lit("U"), F.lit("D")), (k % 3 + 1).cast("int"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    own, held = field("id", c("o_custkey").cast("string")), field("fingerprint", F.concat(F.lit("{-"), k.cast("string"), F.lit(",7}")))
    columns = F.when(k % 3 == 0, F.array(own, held)).when(k % 3 == 1, F.array(held))
    line = F.to_json(F.struct(action.alias("action"), F.lit("public").alias("schema"), F.lit("fingerprint").alias("table"), F.concat(F.lit("0/"), F.hex(k)).alias("lsn"), F.lit(1).alias("xid"), columns.alias("columns"), F.when(k % 3 > 0, F.array(own)).alias("identity")))
    other = F.lit('{"action":"B"}')
    lines = table(spark, sf_dir, "orders").select(F.explode(F.array(line, other)).alias("value"))
    last = ch.latest_changes(ch.decoded(lines)).where("not broken")
    return last.select("id", c("lsn").cast("long").alias("lsn"), "action", F.array_join("hashes", ",").alias("hashes"))


@query(
    "o008_messages",
    """SELECT 'changes.' || o_custkey AS subject, max(o_orderkey) AS lsn, '{"id":' || o_custkey || ',"kind":"update","query":[0'
|| CASE WHEN o_custkey >= 16 THEN ',' || (o_custkey - o_custkey % 16) ELSE '' END || '],"simhash":' || (o_custkey & 1) || '}' AS body FROM orders GROUP BY o_custkey""",
)
def messages(spark, sf_dir):
    """Messages of two batches, one of which comes twice, in a store that keeps the newest of each subject."""
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").cast("decimal(20,0)").alias("lsn"), F.lit("U").alias("action"), c("o_custkey").alias("id"), F.array(F.lit(1), c("o_custkey").cast("int")).alias("hashes"))
    folder = tb.shared_folder(spark, "messages")
    for i in (1, 0, 1):
        lg.keep_messages(spark, ch.message(ch.latest_changes(rows.where(f"lsn % 2 = {i}"))), folder)
    return lg.kept_messages(spark, folder).select("subject", c("lsn").cast("long").alias("lsn"), "body")


@query("o141b_change_stream", "SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id) AS id, doc_id AS fingerprint_id FROM documents")
def change_stream(spark, sf_dir):
    """Documents go into a log in three months, and come out of it as a stream, in two runs with one checkpoint."""
    with tb.Scratch(spark) as scratch:
        corpus = scratch.keep(fingerprints(spark, sf_dir, "documents", "doc_id"), "corpus")
        held = lg.ChangeLog(spark)
        out = tb.shared_folder(spark, "streamed")
        scratch.paths += [held.folder, f"{out}/checkpoint"]
        for i in range(3):
            held.append(corpus.where(f"id % 3 = {i}"), date(2024, i + 1, 5))
            if i > 0:
                stream = lg.changes_stream(spark, held.folder, page=10_000).writeStream.format("parquet").option("path", f"{out}/rows")
                stream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id BIGINT, fingerprint_id BIGINT, query ARRAY<BIGINT>").parquet(f"{out}/rows").select("id", "fingerprint_id")


@query("o142_floor", "SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id) AS id, doc_id AS fingerprint_id FROM documents QUALIFY id > (SELECT count(*) FROM documents WHERE doc_id % 3 = 0)")
def above_the_floor(spark, sf_dir):
    """What a log of three months has left once the first one was dropped, read from its floor."""
    with tb.Scratch(spark) as scratch:
        corpus = scratch.keep(fingerprints(spark, sf_dir, "documents", "doc_id"), "corpus")
        held = lg.ChangeLog(spark)
        for i in range(3):
            held.append(corpus.where(f"id % 3 = {i}"), date(2024, i + 1, 5))
        held.maintain(date(2024, 4, 10))
        return held.rows(held.floor()).select("id", "fingerprint_id")


@query(
    "o047_index",
    f"""WITH {_TERMS}, w AS (SELECT doc_id, unnest(h) AS x FROM d WHERE doc_id % 9 = 4)
SELECT doc_id AS id, term FROM t WHERE n <= 120 AND doc_id % 9 NOT IN (0, 4)
UNION ALL SELECT DISTINCT doc_id, x - x % 16 FROM w""",
)
def grown_index(spark, sf_dir):
    """All documents in a stored index that grows in three steps, then loses every ninth document, gets others anew, and is compacted."""
    with tb.Scratch(spark) as scratch:
        corpus = scratch.keep(fingerprints(spark, sf_dir, "documents", "doc_id"), "corpus")
        n = corpus.count()
        index = se.empty_index(spark, buckets=8).grown(corpus, n // 2).grown(corpus, n // 3).grown(corpus, n)
        index = index.updated(corpus.where("id % 9 in (0, 4)").select("id", F.when(c("id") % 9 == 4, c("hashes")).alias("hashes")), {"batch": 1})
        return index.compacted().terms


_SCORED = f"""WITH d AS (SELECT doc_id, {_HASHES} AS h FROM documents),
q AS (SELECT doc_id AS q, unnest(h[greatest(0, least(len(h) - 120, 80)) + 1:]) AS v, generate_subscripts(h[greatest(0, least(len(h) - 120, 80)) + 1:], 1) AS i FROM d WHERE doc_id % 25 = 0),
qg AS (SELECT q, v - v % 16 AS term, min(i) AS i FROM q GROUP BY 1, 2),
qt AS (SELECT q, term FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY i) AS n FROM qg) WHERE n <= 120),
c AS (SELECT DISTINCT doc_id, x - x % 16 AS term FROM (SELECT doc_id, unnest(h) AS x FROM d)),
m AS (SELECT q, doc_id, count(*) AS matches FROM qt JOIN c USING (term) GROUP BY 1, 2),
r AS (SELECT *, max(matches) OVER (PARTITION BY q) AS best, row_number() OVER (PARTITION BY q ORDER BY matches DESC, doc_id) AS place FROM m),
p AS (SELECT q, r.doc_id, a.h AS a, b.h AS b FROM r JOIN d a ON a.doc_id = q JOIN d b ON b.doc_id = r.doc_id WHERE matches * 100 > best * 10 AND place <= 20 AND abs(len(a.h) - len(b.h)) <= 7),
o AS (SELECT q, doc_id, a, b, unnest(range(-80, 81)) AS o FROM p),
w AS (SELECT q, doc_id, o, least(len(a), len(b)) AS least, a[1 + greatest(0, o):] AS a, b[1 + greatest(0, -o):] AS b FROM o),
n AS (SELECT *, least(len(a), len(b)) AS n FROM w),
e AS (SELECT q, doc_id, least, n, list_sum(list_transform(range(1, n + 1), lambda i: bit_count(xor(a[i], b[i])))) AS errors FROM n WHERE n > 0),
s AS (SELECT q, doc_id, power(greatest(0.0E0, max((1 - errors / (16.0E0 * n)) * n / least)), 2) AS score FROM e GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0.4),
g AS (SELECT *, row_number() OVER (PARTITION BY q, doc_id // 4 ORDER BY score DESC, doc_id) AS k FROM l WHERE l.n <= 10)
SELECT q AS query_id, doc_id AS id, doc_id // 4 AS "group", round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank
FROM g WHERE k = 1"""


@query("o040_search", _SCORED)
def run_search(spark, sf_dir):
    """Every 25th document is looked up among all, over a stored index: length band, exact scores, the first ten, and of these the best of each group of four."""
    with tb.Scratch(spark) as scratch:
        corpus = fingerprints(spark, sf_dir, "documents", "doc_id").withColumns({"length": F.size("hashes"), "group": F.floor(c("id") / 4).cast("long")})
        corpus = scratch.keep(corpus, "corpus")
        index = se.empty_index(spark, buckets=8).updated(corpus)
        asked = corpus.where("id % 25 = 0").select(c("id").alias("query_id"), "hashes", "length")
        found = scratch.keep(se.search(asked, corpus, index=index, scratch=scratch), "found", outlive=True)
        remove_index(index)
    return found.withColumn("score", F.round("score", 9))


@query(
    "o041_stored",
    """WITH r AS (SELECT o_custkey AS q, o_orderkey AS id, (o_orderkey % 1000) / 1000.0E0 AS score FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS n FROM r WHERE score > 0.4),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id) AS k FROM t WHERE n <= 100 AND abs(q % 20 - id % 23) <= 7),
g AS (SELECT *, row_number() OVER (PARTITION BY q, id % 5 ORDER BY score DESC, id) AS f FROM b WHERE k <= 10)
SELECT q AS query_id, id, id % 5 AS "group", score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM g WHERE f = 1""",
)
def stored(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("query_id"), c("o_orderkey").alias("id"), (c("o_orderkey") % 1000 / 1000.0).alias("score"))
    corpus = rows.select("id", (c("id") % 5).alias("group"), (c("id") % 23).alias("length"))
    return se.search_stored(rows, rows.select("query_id", (c("query_id") % 20).alias("length")).distinct(), corpus)


@query("o044_by_gid", "SELECT c_custkey AS query_id, 'g' || c_custkey AS result, CASE WHEN c_custkey % 2 = 1 THEN c_custkey - 1 ELSE c_custkey END AS track_id, 1.0E0 AS score FROM customer WHERE c_custkey % 3 = 0")
def by_gid(spark, sf_dir):
    """Tracks asked for by gid, some of which lead elsewhere, and no fingerprints."""
    k = c("c_custkey")
    tracks = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("g"), k.cast("string")).alias("gid"), F.when(k % 2 == 1, k - 1).alias("new_id"))
    none = fingerprints(spark, sf_dir, "benchmark", "item_id").where("false").withColumns({"length": F.size("hashes"), "group": c("id")})
    wanted = tracks.where("id % 3 = 0").select(c("id").alias("query_id"), "gid")
    return se.lookup(none.select(c("id").alias("query_id"), "hashes", "length"), wanted, none, tracks)


@query("o148_stream_hourly", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed(spark, sf_dir):
    out = tb.shared_folder(spark, "hourly")
    feed.hourly_counts(spark, sf_dir, "events.parquet", f"{out}/counts", f"{out}/checkpoint")
    tb.delete(spark, f"{out}/checkpoint")
    return feed.newest_counts(spark, f"{out}/counts").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
