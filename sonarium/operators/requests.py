"""Requests: a reason for each refused row, numbered parameters, submissions by item, queues, and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions import text as tx

#: The longest duration, seconds of a bucket and buckets of a window for rate limits.
LONGEST, BUCKET_SECONDS, BUCKETS = 0x7FFF, 5, 4


def validated(requests: DataFrame) -> DataFrame:
    """Requests (client, duration, bitrate, mbid, foreign_id, and user where accounts are needed) with `error`, the first rule that a row breaks, or null.

    Every row stays: of a request with numbered parts, one bad part does not spoil the others."""
    bad = F.when(F.col("client").isNull() | (F.col("client") == ""), "missing client")
    if "user" in requests.columns:
        bad = bad.when(F.coalesce("user", F.lit("")) == "", "missing user")
    bad = bad.when(~F.coalesce(F.col("duration").between(1, LONGEST), F.lit(False)), "invalid duration")
    bad = bad.when(F.col("bitrate") <= 0, "invalid bitrate")
    bad = bad.when(F.col("mbid").isNotNull() & ~tx.is_uuid(F.col("mbid")), "invalid uuid")
    return requests.withColumn("error", bad.when(F.col("foreign_id").isNotNull() & ~tx.is_foreign_id(F.col("foreign_id")), "invalid foreign id"))


#: Parameters of the first version, by the names that they have now.
OLD_NAMES = {"length": "duration", "format": "fileformat"}


def renamed(params: Column) -> Column:
    """A map of parameters of the first version, under today's names."""
    names = F.create_map(*[F.lit(x) for pair in OLD_NAMES.items() for x in pair])
    return F.transform_keys(params, lambda k, _: F.concat(F.coalesce(names[F.substring_index(k, ".", 1)], F.substring_index(k, ".", 1)), F.regexp_extract(k, r"(\..*)?$", 0)))


def parts(params: Column, names: list[str]) -> Column:
    """A request's parts: for each number that any of the parameters bears (-1 for none), a struct of n and their values."""
    held = {name: numbered(params, name) for name in names}
    every = F.array_sort(F.array_distinct(F.concat(*[F.transform(v, lambda e: e["n"]) for v in held.values()])))
    value = lambda name, n: F.element_at(F.filter(held[name], lambda e: e["n"] == n), 1)["value"]
    pick = lambda name, n: F.when(F.exists(held[name], lambda e: e["n"] == n), value(name, n)).alias(name)
    return F.transform(every, lambda n: F.struct(n.alias("n"), *[pick(name, n) for name in names]))


#: The difference of lengths that a lookup allows unless told otherwise, and the largest one that may be asked for.
LENGTH_DIFF, LARGEST_LENGTH_DIFF = 7, 30


def lookup_request(params: Column) -> Column:
    """A lookup's map of parameters as a struct: band (the difference of lengths allowed), queries (n, trackid, duration, fingerprint, error) and error.

    A part with a track id asks for that; else it needs a duration and a fingerprint. A bad part is left out by whoever asks,
    as its error says; the request as a whole fails with the last part's error where no part is good, where there is none, or
    where the difference is out of bounds. A number that is none counts as not given."""
    named = parts(params, ["trackid", "fingerprint", "duration"])
    asked = F.filter(named, lambda p: p["trackid"].isNotNull() | p["fingerprint"].isNotNull())
    given = lambda v: F.coalesce(v, F.lit("")) != ""
    number = lambda v: F.when(v.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(v).cast("int"))

    def query(p: Column) -> Column:
        seconds = F.coalesce(number(p["duration"]), F.lit(0))
        by_gid = F.when(~tx.is_uuid(p["trackid"]), "invalid uuid")
        by_print = F.when(seconds == 0, "missing duration").when(~given(p["fingerprint"]), "missing fingerprint")
        return F.struct(p["n"].alias("n"), p["trackid"].alias("trackid"), seconds.alias("duration"), p["fingerprint"].alias("fingerprint"), F.when(given(p["trackid"]), by_gid).otherwise(by_print).alias("error"))

    queries = F.transform(asked, query)
    diff = number(F.try_element_at(params, F.lit("maxdurationdiff")))
    band = F.coalesce(diff, F.lit(LENGTH_DIFF))
    error = F.when(~band.between(1, LARGEST_LENGTH_DIFF), "invalid maxdurationdiff").when(F.size(asked) == 0, "missing fingerprint")
    error = error.when(F.forall(queries, lambda q: q["error"].isNotNull()), F.element_at(queries, -1)["error"])
    return F.struct(band.alias("band"), queries.alias("queries"), error.alias("error"))


def numbered(params: Column, name: str) -> Column:
    """Of a map of parameters, those called name, name.0, name.1 and so on as structs of n (-1 without a number) and value, by n."""
    mine = F.filter(F.map_entries(params), lambda e: e["key"].rlike(rf"^{name}(\.[0-9]{{1,9}})?$"))
    number = lambda e: F.coalesce(F.nullif(F.regexp_extract(e["key"], r"\.([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(-1))
    return F.array_sort(F.transform(mine, lambda e: F.struct(number(e).alias("n"), e["value"].alias("value"))))


def wanted(meta: Column) -> Column:
    """What a meta parameter asks for: nothing for 0 or none, recording ids for 1, the second format for 2, else its words, cut at white space."""
    words = F.filter(F.split(F.coalesce(meta, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(meta, F.lit("")).isin("", "0"), none).when(meta == "1", F.array(F.lit("recordingids"))).when(meta == "2", F.array(F.lit("m2"))).otherwise(words)


def document_kind(words: Column) -> Column:
    """The document to build: the second format before recordings, these before release groups, these before releases."""
    has = lambda *names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    return F.when(has("m2"), "m2").when(has("recordings", "recordingids", "isrcs"), "recordings").when(has("releasegroups", "releasegroupids"), "releasegroups").when(has("releases", "releaseids"), "releases")


def fan_out(submissions: DataFrame) -> DataFrame:
    """A row for each of `mbids`, or one with a null; rows with neither item, puid, foreign id nor any metadata go."""
    rows = submissions.withColumn("mbid", F.explode_outer("mbids")).drop("mbids")
    return rows.where(F.coalesce("mbid", "puid", "foreign_id", "meta").isNotNull())


def take_queued(queue: DataFrame, handled: DataFrame, most: int) -> DataFrame:
    """The first rows of a queue by id, without those whose submission is handled. Taken rows stay queued until it is."""
    return queue.join(handled.select("id"), "id", "left_anti").orderBy("id").limit(most)


def limited(hits: DataFrame, key: str, time: str, per_second: float) -> DataFrame:
    """key, bucket (seconds), hits and accepted: as many as the window of BUCKETS buckets has room for; refused hits do not count.

    Hits are counted before the shuffle. A gap of a whole window forgets the past, so a task holds one unbroken run of
    buckets of a key at a time, not its hits."""
    most = int(per_second * BUCKET_SECONDS * BUCKETS)
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    counted = hits.groupBy(key, (seconds - F.pmod(seconds, F.lit(BUCKET_SECONDS))).alias("bucket")).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(key).orderBy("bucket")
    apart = F.coalesce(F.col("bucket") - F.lag("bucket").over(w) >= BUCKETS * BUCKET_SECONDS, F.lit(True))
    runs = counted.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("bucket", "hits"))).alias("b"))

    def step(done: Column, x: Column) -> Column:
        recent = F.filter(F.slice(done, -(BUCKETS - 1), BUCKETS - 1), lambda d: d["bucket"] > x["bucket"] - BUCKETS * BUCKET_SECONDS)
        used = F.aggregate(recent, F.lit(0).cast("long"), lambda s, d: s + d["accepted"])
        return F.concat(done, F.array(F.struct(x["bucket"].alias("bucket"), x["hits"].alias("hits"), F.least(x["hits"], F.greatest(F.lit(0).cast("long"), most - used)).alias("accepted"))))

    # The three last buckets suffice, but a fold needs its start to have them: three that lie far back.
    start = F.array(*[F.struct(F.lit(-(10**15)).cast("long").alias("bucket"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("accepted"))] * (BUCKETS - 1))
    folded = runs.select(key, F.explode(F.slice(F.aggregate("b", start, step), BUCKETS, 2**30)).alias("r"))
    return folded.select(key, "r.*")


def refused_by(application_ok: Column, global_ok: Column, address_ok: Column, application_limit: Column, trusted: Column) -> Column:
    """The limit that refuses a request, or null: the application's, then the global one, then the address's unless the application has a limit of its own. Trusted callers pass."""
    return F.when(F.coalesce(trusted, F.lit(False)), F.lit(None).cast("string")).when(~application_ok, "application").when(~global_ok, "global").when(application_limit.isNull() & ~address_ok, "address")
