"""Queries that look up, join and sort: customers stand for tracks, orders for links, parts for catalogue items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonarium.functions import text as tx
from sonarium.operators import accounts as ac
from sonarium.operators import clusters as cl
from sonarium.operators import lookup as lo
from sonarium.operators import state as st
from sonarium.operators.imports import statuses
from sonarium.plans.registry import query
from sonarium.sources import tables as tb
from sonarium.sources.tables import table

c = F.col


@query("o001_scan", "SELECT o_orderkey, o_custkey FROM orders")
def scanned(spark, sf_dir):
    """A replica is read where only reading is asked for; the other address would fail."""
    held = tb.Databases(spark, {"main": "/nowhere"}, {"main": sf_dir})
    return held.scan("main", "orders").select("o_orderkey", "o_custkey")


@query("o002_point", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def point(spark, sf_dir):
    return lo.find(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), o_orderkey=7)


@query("o003_multi_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 1, 7, 999999999)")
def multi_get(spark, sf_dir):
    return lo.multi_get(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", [3, 1, 7, 999999999])


@query("o004_page", "SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def paged(spark, sf_dir):
    return lo.page(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 100, 50)


@query("o005_range", "SELECT (event_id - lo) // 100 AS chunk, count(*) AS n FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events) WHERE event_id < hi - 50 GROUP BY 1")
def ranged(spark, sf_dir):
    """Rows in each range of a hundred ids, without the newest fifty."""
    events = table(spark, sf_dir, "events").select("event_id")
    ends = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    edges = list(lo.ranges(ends.low, ends.high, 100, 50))
    kept = lo.in_range(events, "event_id", edges[0][0], edges[-1][1])
    return kept.groupBy(F.floor((c("event_id") - ends.low) / 100).cast("long").alias("chunk")).agg(F.count("*").alias("n"))


@query("o050_predicates", "SELECT c_custkey FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000005') OR (c_nationkey BETWEEN 3 AND 5 AND c_acctbal > 100 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))")
def predicates(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    named = lo.find_same_name(customers, "c_name", "customer#000000005").select("c_custkey")
    others = customers.where(c("c_nationkey").between(3, 5) & (c("c_acctbal") > 100) & c("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select("c_custkey")
    return named.unionByName(others).distinct()


@query("o051_null_safe", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'v' || o_orderkey % 2 END AS version FROM orders WHERE o_orderkey % 3 = 0")
def null_safe(spark, sf_dir):
    k = c("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 3 > 0, F.concat(F.lit("v"), (k % 2).cast("string"))).alias("version"))
    return lo.find(rows, version=None)


@query("o052_inner_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def inner_join(spark, sf_dir):
    """Every fingerprint (a line) with its track (the order's customer)."""
    tracks = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), "o_custkey")
    prints = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("track_id"), "l_linenumber")
    return lo.with_tracks(prints, tracks).select(c("track_id").alias("l_orderkey"), "l_linenumber", "o_custkey")


def part_links(spark, sf_dir):
    """Lines as links of orders (tracks) to brands (items), returned ones disabled."""
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("l_partkey"), c("p_brand").alias("brand"))
    line = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    rows = line.select(c("l_orderkey").alias("track_id"), "brand", c("l_linenumber").alias("submission_count"), (c("l_returnflag") == "R").alias("disabled"))
    return rows, table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("gid"))


@query("o053_links", "SELECT p_brand AS brand, l_orderkey AS track_id, 'o' || l_orderkey AS gid, l_linenumber AS submission_count, false AS disabled FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND l_returnflag <> 'R'")
def links(spark, sf_dir):
    return lo.links_of(*part_links(spark, sf_dir), ["Brand#11", "Brand#12", "Brand#23"], "brand", disabled=False)


@query("o097_by_item", "WITH a(brand) AS (VALUES ('Brand#11'), ('Brand#12'), ('nobody')), x AS (SELECT p_brand AS brand, l_orderkey AS t FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R') SELECT a.brand, coalesce(string_agg('o' || t, ',' ORDER BY t) FILTER (WHERE t IS NOT NULL), '') AS tracks FROM a LEFT JOIN x USING (brand) GROUP BY 1")
def by_item(spark, sf_dir):
    asked = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("nobody",)], "brand string")
    return lo.listed_by_item(asked, *part_links(spark, sf_dir), "brand").select("brand", F.array_join("tracks", ",").alias("tracks"))


@query("o054_join_chain", "SELECT l_orderkey, l_linenumber, c_name, n_name, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1 WHERE l_quantity > 45")
def join_chain(spark, sf_dir):
    tracks = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(c("l_orderkey").alias("medium"), "l_linenumber", "l_quantity")
    mediums = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("release"))
    releases = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), "c_name", c("c_nationkey").alias("place"))
    events = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(c("n_nationkey").alias("place"), "n_name")
    return lo.placements(tracks, mediums, releases, events).select(c("medium").alias("l_orderkey"), "l_linenumber", "c_name", "n_name", "l_quantity")


@query("o055_left_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey > 5 LEFT JOIN region ON r_regionkey = n_regionkey")
def left_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey > 5").select(c("n_nationkey").alias("s_nationkey"), "n_name", c("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return lo.with_names(table(spark, sf_dir, "supplier"), ("s_nationkey", nation), ("r_regionkey", region)).select("s_suppkey", "n_name", "r_name")


@query("o060_null_length", "SELECT 'p' || p_partkey AS gid, p_name AS title, r_name AS artist, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END / 1000.0E0 AS seconds FROM part JOIN region ON r_regionkey = p_partkey % 5")
def summaries(spark, sf_dir):
    return lo.summaries(*recordings(spark, sf_dir))


def recordings(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("gid"), c("p_name").alias("name"), (c("p_partkey") % 5).alias("artist_credit"), F.when(c("p_size") % 2 == 0, c("p_size")).alias("length"))
    return part, table(spark, sf_dir, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("name"))


@query("o152_recording_page", "WITH x AS (SELECT l_partkey, string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) AS tracks FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT 'p' || p_partkey AS gid, p_name AS title, coalesce(tracks, '') AS tracks FROM part LEFT JOIN x ON l_partkey = p_partkey")
def recording_page(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("track_id"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("item"), F.lit(1).alias("submission_count"), F.lit(True).alias("disabled"))
    tracks = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("gid"))
    pages = lo.recording_page(*recordings(spark, sf_dir), line, tracks, "item")
    return pages.select(c("item").alias("gid"), "title", F.array_join("tracks", ",").alias("tracks"))


@query("o061_redirect", "WITH moved AS (SELECT p_partkey AS old_id, p_partkey - 3 AS new_id FROM part WHERE p_partkey % 10 = 4) SELECT p_partkey, coalesce(new_id, p_partkey) AS target FROM part LEFT JOIN moved ON old_id = p_partkey")
def redirect(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    return lo.redirected(part, part.where("p_partkey % 10 = 4").select("p_partkey", (c("p_partkey") - 3).alias("new")), "p_partkey")


@query("o062_theta_pairs", "SELECT a.s_nationkey, count(*) AS pairs, max(abs(a.s_suppkey - b.s_suppkey)) AS furthest FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_nationkey")
def theta_pairs(spark, sf_dir):
    members = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("block"), c("s_suppkey").alias("id"), c("s_suppkey").alias("track"), c("s_suppkey").alias("length"), F.array(F.lit(1)).alias("hashes"))
    return cl.member_pairs(members).groupBy(c("block").alias("s_nationkey")).agg(F.count("*").alias("pairs"), F.max("length_diff").alias("furthest"))


@query("o062b_track_pairs", "SELECT a.s_nationkey AS block, a.s_suppkey % 3 AS a, b.s_suppkey % 3 AS b, 1.0E0 AS score, max(abs(a.s_suppkey - b.s_suppkey)) AS length_diff FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_suppkey % 3 < b.s_suppkey % 3 GROUP BY 1, 2, 3")
def track_pairs(spark, sf_dir):
    members = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("block"), c("s_suppkey").alias("id"), (c("s_suppkey") % 3).alias("track"), c("s_suppkey").alias("length"), F.array(F.lit(1), F.lit(2)).alias("hashes"))
    return cl.track_pairs(members)


@query("o063_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi(spark, sf_dir):
    return lo.present(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey")


@query("o064_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(spark, sf_dir):
    return lo.missing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey")), "c_custkey")


@query("o066_foreign_id", "SELECT n_nationkey, concat(r_name, ':', n_name) AS foreign_id FROM nation JOIN region ON r_regionkey = n_regionkey")
def foreign_id(spark, sf_dir):
    vendors = table(spark, sf_dir, "region").select(c("r_regionkey").alias("vendor"), c("r_name").alias("vendor_name"))
    return lo.with_foreign_id(table(spark, sf_dir, "nation"), vendors, "n_regionkey", "n_name").select("n_nationkey", "foreign_id")


@query("o067_usage", "SELECT n_nationkey AS id, n_name AS name, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS hits, count(c_custkey) FILTER (WHERE c_acctbal <= 0) AS misses FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def usage(spark, sf_dir):
    lookups = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("application"), (c("c_acctbal") > 0).cast("long").alias("hits"), (c("c_acctbal") <= 0).cast("long").alias("misses"))
    return ac.usage(table(spark, sf_dir, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name")), lookups)


@query("o068_outer", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 2 = 0")
def outer(spark, sf_dir):
    even = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(c("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return lo.matched(table(spark, sf_dir, "nation").select("n_nationkey"), even, "n_nationkey")


@query("o069_resolved", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 IN (3, 7) THEN p_partkey - p_partkey % 10 ELSE p_partkey END AS target FROM part")
def resolved(spark, sf_dir):
    """Chains of two hops (7 to 3 to 0) are flat before they are followed."""
    k = c("p_partkey")
    tracks = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 10 == 7, k - 4).when(k % 10 == 3, k - 3).alias("new_id"))
    return st.resolve(st.flattened(tracks))


@query("o079_chains", "SELECT o_orderkey AS id, max(o_orderkey) OVER (PARTITION BY o_custkey) AS target FROM orders")
def chains(spark, sf_dir):
    """Each order leads to its customer's next one, and so to the last."""
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("new_id"))
    return st.resolve(st.flattened(rows))


@query("o083_multi_sort", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS place FROM lineitem")
def multi_sort(spark, sf_dir):
    """All lines with their place in the order of several columns, so that the order itself shows; no task sorts all of them."""
    placed = st.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", c("n").cast("long").alias("place"))


@query("o084_last", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last(spark, sf_dir):
    return lo.last_by(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", "event_id").select("event_id", "user_id")


@query("o085_fallback", "SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END, ''), CAST(s_suppkey AS VARCHAR))) AS place FROM supplier")
def fallback(spark, sf_dir):
    """Suppliers in the order of names, where they have one; the place shows the order."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 2 == 0, c("s_name")).otherwise("").alias("name"))
    placed = st.numbered(rows.withColumn("by", lo.name_or_key("name", "s_suppkey")), ["by"])
    return placed.select("s_suppkey", c("n").cast("long").alias("place"))


@query("o089_sets", "SELECT c_custkey, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INT) AS only_a, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS INT) AS both, CAST(len(list_distinct(a || b)) AS INT) AS either FROM (SELECT c_custkey, [c_custkey % 3, c_custkey % 5 + 10, 20] AS a, [c_custkey % 2, c_custkey % 7 + 10, 20] AS b FROM customer)")
def sets(spark, sf_dir):
    k = c("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.array(k % 3, k % 5 + 10, F.lit(20).cast("long")).alias("a"), F.array(k % 2, k % 7 + 10, F.lit(20).cast("long")).alias("b"))
    return rows.select(k, F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"))


@query("o089_difference", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def difference(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(c("c_custkey").alias("id"))
    return lo.missing(table(spark, sf_dir, "orders").select(c("o_custkey").alias("id")), known, "id")


@query("o049_projection", "SELECT CAST(o_orderkey AS VARCHAR(20)) AS id, o_custkey / 1000.0E0 AS share FROM orders")
def projection(spark, sf_dir):
    return lo.public(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@query("o098_status", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE 'imported' END AS status, CASE WHEN o_orderkey % 4 > 0 THEN 'g' || CASE WHEN o_custkey % 2 = 1 THEN o_custkey - o_custkey % 10 ELSE o_custkey END END AS gid FROM orders JOIN customer ON c_custkey = o_custkey")
def status(spark, sf_dir):
    """Orders as submissions, of which a fourth has no result yet; odd customers were merged into others."""
    order = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey")), "o_custkey")
    every = order.select("o_custkey").unionByName(order.select((c("o_custkey") - c("o_custkey") % 10).alias("o_custkey"))).distinct()
    k = c("o_custkey")
    tracks = every.select(k.alias("id"), F.concat(F.lit("g"), k.cast("string")).alias("gid"), F.when(k % 2 == 1, k - k % 10).alias("new_id"))
    results = order.where("o_orderkey % 4 > 0").select(c("o_orderkey").alias("submission_id"), k.alias("track_id"))
    return statuses(order.select(c("o_orderkey").alias("id")), results, tracks)


@query("o128_edits", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'off' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 > 0")
def edits(spark, sf_dir):
    k = c("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    renamed = ac.edited(rows, "c_custkey", rows.where("c_custkey % 3 = 0").select(k, F.concat(F.lit("new"), k.cast("string")).alias("name"), F.lit(None).cast("string").alias("segment")))
    return ac.without(ac.touched(renamed, "c_custkey", rows.where("c_custkey % 5 = 0"), "segment", F.lit("off")), rows.where("c_custkey % 7 = 0"), "c_custkey")


@query("o015_insert", "SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_name) AS id, s_name AS name FROM supplier")
def insert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name"))
    return ac.inserted(nation, table(spark, sf_dir, "supplier").select(c("s_name").alias("name")))[1]


@query("o102_patterns", "SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS uuid, o_orderkey % 4 = 2 AS foreign_id, o_orderkey % 4 = 3 AS email FROM orders")
def patterns(spark, sf_dir):
    k = c("o_orderkey")
    u = "b81f83ee-4da4-11e0-9ed8-0025225356f3"
    v = F.element_at(F.array(*map(F.lit, (u, u.upper(), "vendor:x:y", "a.b@example.org"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k, tx.is_uuid(v).alias("uuid"), tx.is_foreign_id(v).alias("foreign_id"), tx.is_email(v).alias("email"))


@query("o013_dump", r"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN chr(10) || 'a' || chr(9) || '\N' WHEN 1 THEN '' WHEN 2 THEN '\N' ELSE c_name || '\\n' END AS c_name, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS c_nationkey, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def dumped(spark, sf_dir):
    """Rows as they come back from a dump: with newlines, tabs, backslashes, empty texts and nulls."""
    path = tb.shared_folder(spark, "dump")
    k = c("c_custkey")
    name = F.when(k % 4 == 0, F.lit("\na\t\\N")).when(k % 4 == 1, F.lit("")).when(k % 4 == 2, F.lit("\\N")).otherwise(F.concat("c_name", F.lit("\\\\n")))
    rows = table(spark, sf_dir, "customer").select(k, name.alias("c_name"), F.when(k % 3 > 0, c("c_nationkey")).alias("c_nationkey"), "c_acctbal", (k % 2 == 0).alias("even"))
    tb.dump(rows, path)
    return tb.load(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
