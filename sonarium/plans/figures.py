"""Queries of statistics: customers stand for tracks and accounts, orders for links and submissions, events for lookups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sonarium.operators import statistics as sx
from sonarium.plans.registry import query
from sonarium.sources.tables import table

c = F.col
#: Daily values by event type, for both engines.
_DAYS = "SELECT event_type AS name, CAST(ts AS DATE) AS date, count(*) AS value FROM events GROUP BY 1, 2"
#: Hourly lookups by user as application: errors are misses.
_LOOKUPS = "SELECT CAST(ts AS DATE) AS date, user_id AS application, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS hits, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS misses FROM events"


def days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(c("event_type").alias("name"), F.to_date("ts").alias("date")).agg(F.count("*").alias("value"))


def lookups(spark, sf_dir):
    bad = (c("event_type") == "error").cast("long")
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), c("user_id").alias("application"), (1 - bad).alias("hits"), bad.alias("misses"))


@query(
    "o070_gauges",
    """SELECT * FROM (VALUES
('account.all', (SELECT count(*) FROM customer)), ('account.linked', (SELECT count(*) FROM customer WHERE c_acctbal > 0)),
('account.login', (SELECT count(DISTINCT s_nationkey) FROM supplier)), ('account.active', (SELECT count(DISTINCT o_custkey) FROM orders)),
('application.all', (SELECT count(*) FROM nation)), ('format.all', (SELECT count(*) FROM region)),
('fingerprint.all', (SELECT count(*) FROM lineitem)), ('track_mbid.all', (SELECT count(*) FROM orders)),
('mbid.all', (SELECT count(DISTINCT o_custkey) FROM orders)), ('track.all', (SELECT count(*) FROM part)),
('submission.all', (SELECT CAST(sum(p_size) AS BIGINT) FROM part)), ('submission.unhandled', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F'))) AS t(name, value)""",
)
def gauges(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "orders", "nation", "region", "lineitem", "part")}
    every = F.count("*")
    return sx.gauges(
        [
            (t["customer"], {"account.all": every, "account.linked": F.count_if(c("c_acctbal") > 0)}),
            (t["supplier"], {"account.login": F.count_distinct("s_nationkey")}),
            (t["orders"], {"account.active": F.count_distinct("o_custkey"), "track_mbid.all": every, "mbid.all": F.count_distinct("o_custkey"), "submission.unhandled": F.count_if(c("o_orderstatus") != "F")}),
            (t["nation"], {"application.all": every}),
            (t["region"], {"format.all": every}),
            (t["lineitem"], {"fingerprint.all": every}),
            (t["part"], {"track.all": every, "submission.all": F.sum("p_size")}),
        ]
    )


_HISTOGRAM = "h AS (SELECT CAST(least(n, 10) AS INT) AS bucket, count(*) AS keys FROM c GROUP BY 1), b AS (SELECT CAST(v AS INT) AS bucket FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS t(v)) SELECT b.bucket, coalesce(keys, 0) AS keys FROM b LEFT JOIN h ON h.bucket = b.bucket"


@query("o071_histogram_of_counts", f"WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey), {_HISTOGRAM}")
def tracks_by_items(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), (c("o_orderstatus") != "F").alias("disabled"))
    return sx.tracks_by_items(table(spark, sf_dir, "customer"), links, "c_custkey")


@query("o071b_items_by_tracks", f"WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), {_HISTOGRAM}")
def items_by_tracks(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select("l_partkey", (c("l_returnflag") != "R").alias("disabled"))
    return sx.items_by_tracks(links, "l_partkey")


@query("o072_hits_by_day", f"SELECT date, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, count(*) AS total FROM ({_LOOKUPS}) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-18' AND application IN (1, 2, 3, 5, 8, 13) GROUP BY 1")
def by_day(spark, sf_dir):
    """The last two weeks before the 19th, which itself is left out."""
    first, last = sx.window(days=14, today=date(2024, 1, 19))
    return sx.daily(lookups(spark, sf_dir), first, last, [1, 2, 3, 5, 8, 13])


@query("o073_monthly", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def by_month(spark, sf_dir):
    return sx.monthly(table(spark, sf_dir, "orders"), "o_orderdate", F.count("*").alias("orders"), F.sum("o_custkey").alias("keys"))


@query("o074_ratio", f"SELECT application, n_name AS name, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, count(*) AS total, round(100.0E0 * sum(hits) / count(*), 2) AS ratio FROM ({_LOOKUPS}) JOIN nation ON n_nationkey = application WHERE date_trunc('month', date) = DATE '2024-01-01' GROUP BY 1, 2")
def by_application(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("application"), c("n_name").alias("name"))
    return sx.applications_of_month(lookups(spark, sf_dir), names, date(2024, 1, 15))


@query("o075_group_sum_min", "SELECT p_name AS track, p_brand AS artist, p_type AS album, CAST(sum(l_linenumber) AS BIGINT) AS submission_count, CAST(min(l_shipdate) AS DATE) AS created FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3")
def group_sum_min(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("meta_id"), c("l_linenumber").alias("submission_count"), F.to_date("l_shipdate").alias("created"))
    metadata = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("track"), c("p_brand").alias("artist"), c("p_type").alias("album"))
    return sx.metadata_of_track(links, metadata)


@query("o076_count_and_sum", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS total FROM orders GROUP BY o_custkey")
def count_and_sum(spark, sf_dir):
    rows = sx.count_and_sum(table(spark, sf_dir, "orders"), "o_custkey", c("o_totalprice").cast("decimal(18, 2)"))
    return rows.withColumn("total", c("total").cast("decimal(18, 2)"))


@query("o078_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def having(spark, sf_dir):
    return sx.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("o078c_extremes", "SELECT min(event_id) AS low, coalesce(max(event_id), 0) AS high FROM events")
def extremes(spark, sf_dir):
    return sx.extremes(table(spark, sf_dir, "events"), "event_id")


@query("o078d_backfill", "WITH first AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS day FROM orders WHERE o_custkey > 10 AND o_custkey <= 100 GROUP BY o_custkey) SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN DATE '2000-01-01' END, day) AS created FROM customer LEFT JOIN first ON o_custkey = c_custkey")
def backfill(spark, sf_dir):
    k = c("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, F.to_date(F.lit("2000-01-01"))).alias("created"))
    return sx.backfilled(rows, table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("created")), "c_custkey", 10, 100)


@query("o078e_distinct", "SELECT l_partkey, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY l_partkey")
def distinct(spark, sf_dir):
    return sx.distinct_sources(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("o078f_percent", "SELECT c_nationkey AS bucket, count(*) AS n, printf('%.2f', 100.0E0 * count(*) / sum(count(*)) OVER ()) AS percent FROM customer WHERE c_nationkey <> 0 GROUP BY 1")
def percent(spark, sf_dir):
    return sx.shares(table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("bucket")).agg(F.count("*").alias("n")))


@query("o080_daily_delta", f"WITH d AS ({_DAYS}), x AS (SELECT name, date, value - lag(value, 1, 0) OVER (PARTITION BY name ORDER BY date) AS change FROM d WHERE name IN ('click', 'error', 'view') AND date >= DATE '2024-01-03') SELECT name, date, change FROM x WHERE date > (SELECT min(date) FROM d WHERE name IN ('click', 'error', 'view') AND date >= DATE '2024-01-03')")
def daily_delta(spark, sf_dir):
    return sx.changes_by_day(days(spark, sf_dir), ["click", "error", "view"], date(2024, 1, 3))


@query("o080b_pivot", f"WITH d AS ({_DAYS}), x AS (SELECT name, date, value - lag(value, 1, 0) OVER (PARTITION BY name ORDER BY date) AS change FROM d) SELECT date, CAST(coalesce(sum(change) FILTER (WHERE name = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(change) FILTER (WHERE name = 'error'), 0) AS BIGINT) AS error FROM x WHERE date > (SELECT min(date) FROM d) GROUP BY 1")
def pivot(spark, sf_dir):
    return sx.pivoted(sx.changes_by_day(days(spark, sf_dir)), ["click", "error"])


@query("o081_latest", f"WITH d AS ({_DAYS}) SELECT name, value FROM d WHERE date = (SELECT max(date) FROM d)")
def latest(spark, sf_dir):
    return sx.snapshot(days(spark, sf_dir))


@query("o082_top_per_group", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT o_custkey, o_orderkey, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sx.top_per_group(rows, "o_custkey", 10, F.desc("o_totalprice"), "o_orderkey").drop("o_totalprice")


@query("o065_left_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_count(spark, sf_dir):
    links = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return sx.counts_of(links, "c_custkey", table(spark, sf_dir, "customer"))


@query("o087_islands", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM d) SELECT user_id, min(day) AS first, count(*) AS days FROM g GROUP BY user_id, island")
def islands(spark, sf_dir):
    return sx.islands(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("o088_months", "SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), DATE '2026-02-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM orders")
def months(spark, sf_dir):
    return sx.months_between(table(spark, sf_dir, "orders"), "o_orderdate", F.to_date(F.lit("2026-02-17")))


@query("o151_derived", "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT count(*) AS everything, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS some, printf('%.2f', 100.0E0 * sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) / count(*)) AS percent FROM c")
def derived(spark, sf_dir):
    return sx.with_and_without(page_gauges(spark, sf_dir))


def page_gauges(spark, sf_dir):
    """track.all, and track.0mbids to track.10mbids."""
    customers = table(spark, sf_dir, "customer")
    links = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), F.lit(False).alias("disabled"))
    held = sx.tracks_by_items(customers, links, "c_custkey").select(F.concat(F.lit("track."), c("bucket").cast("string"), F.lit("mbids")).alias("name"), c("keys").alias("value"))
    return held.unionByName(sx.gauges([(customers, {"track.all": F.count("*")})]))


@query("o151b_distribution", "WITH c AS (SELECT c_custkey, least(count(o_orderkey), 10) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), h AS (SELECT n, count(*) AS k FROM c GROUP BY 1), b AS (SELECT unnest(range(1, 11)) AS v), w AS (SELECT sum(k) AS whole FROM h WHERE n > 0) SELECT CAST(v AS INT) AS bucket, coalesce(k, 0) AS n, printf('%.2f', coalesce(100.0E0 * coalesce(k, 0) / whole, 0.0)) AS percent FROM b LEFT JOIN h ON h.n = v, w")
def distribution(spark, sf_dir):
    return sx.distribution(page_gauges(spark, sf_dir), "mbids")
