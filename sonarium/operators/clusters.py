"""Entity resolution: which fingerprints may join a track, and which tracks may merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.functions import text as tx
from sonarium.operators.state import closure

#: Fixed value: the id that stands for none.
ZERO_ID = "00000000-0000-0000-0000-000000000000"
#: Least distinct hashes of an import, scores for a track, a fingerprint and a merge, and seconds of difference.
LEAST_HASHES, TRACK_SCORE, SAME_SCORE, MEMBER_SCORE, LENGTH_BAND = 80, 0.75, 0.9, 0.4, 7
#: Below this share a name's score and sources are low; above that a score is good.
LOW_SHARE, GOOD_SCORE = 0.2, 0.5


def gated(submissions: DataFrame) -> DataFrame:
    """Submissions with `refused`: why one is not imported, or null. It must name something (an id of zeros is none), and have enough distinct hashes and a query."""
    named = F.lit(False)
    for c in ("mbid", "puid"):
        named = named | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") & (F.col(c) != ZERO_ID)
    for c in ("meta", "meta_id"):
        named = named | F.col(c).isNotNull() if c in submissions.columns else named
    distinct = F.size(F.array_distinct(F.coalesce("hashes", F.array().cast("array<int>"))))
    refused = F.when(~F.coalesce(named, F.lit(False)), "nothing named").when(distinct < LEAST_HASHES, "too few hashes")
    return submissions.withColumn("refused", refused.when(F.size(fp.extract_query(F.col("hashes"))) == 0, "nothing to index"))


def importable(submissions: DataFrame) -> DataFrame:
    """The submissions that are imported; see gated()."""
    return gated(submissions).where("refused is null").drop("refused")


def member_pairs(members: DataFrame) -> DataFrame:
    """Pairs of fingerprints (id, track, length, hashes, block), the smaller id first; only within a block, which is one decision's tracks."""
    one = lambda s: members.select(F.col("block"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "track", "length", "hashes")])
    pairs = one("a").join(one("b"), "block").where("a_id < b_id")
    return pairs.select("block", "a_id", "b_id", "a_track", "b_track", F.abs(F.col("a_length") - F.col("b_length")).alias("length_diff"), "a_hashes", "b_hashes")


def similarity_matrix(members: DataFrame) -> DataFrame:
    """block, a, b and score of all pairs of a block's fingerprints, both ways, and of each with itself; a fingerprint without others has no row."""
    scored = member_pairs(members).select("block", F.col("a_id").alias("a"), F.col("b_id").alias("b"), fp.compare("a_hashes", "b_hashes").alias("score"))
    ends = scored.select("block", F.explode(F.array("a", "b")).alias("a")).distinct()
    return scored.unionByName(scored.select("block", F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(ends.select("block", "a", F.col("a").alias("b"), F.lit(1.0).alias("score")))


def track_pairs(members: DataFrame) -> DataFrame:
    """block, a, b (tracks, the smaller first), score (the least of their fingerprints' pairs) and length_diff (the largest).

    Only pairs whose ids and tracks are in the same order count, as in the service's own query. Equal fingerprints of a track are compared
    once: two of them have a pair in order if the least id of the one is below the largest of the other. Lengths need no pairs: each fingerprint meets
    the shortest and the longest one before it."""
    same = members.groupBy("block", "track", "hashes").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    one = lambda s: same.select("block", *[F.col(c).alias(f"{s}_{c}") for c in ("track", "hashes", "low", "high")])
    pairs = one("a").join(one("b"), "block").where("a_track < b_track and a_low < b_high").withColumn("score", fp.compare("a_hashes", "b_hashes"))
    keys = ["block", "a", "b"]
    scores = pairs.groupBy("block", F.col("a_track").alias("a"), F.col("b_track").alias("b")).agg(F.min("score").alias("score"))
    tracks = members.select("block", "track").distinct()
    both = tracks.withColumnRenamed("track", "a").join(tracks.withColumnRenamed("track", "b"), "block").where("a < b")
    rows = members.select("block", "track", "id", "length")
    of = lambda s: both.join(rows.withColumnRenamed("track", s), ["block", s]).select(*keys, "id", F.lit(s == "a").alias("first"), "length")
    # Of equal ids the second track's is seen first, as it has no pair with the other.
    until = Window.partitionBy(*keys).orderBy("id", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.when(F.col("first"), F.col("length"))
    seen = of("a").unionByName(of("b")).withColumns({"least": F.min(held).over(until), "most": F.max(held).over(until)}).where("not first")
    lengths = seen.groupBy(*keys).agg(F.max(F.greatest(F.col("most") - F.col("length"), F.col("length") - F.col("least"))).alias("length_diff"))
    return scores.join(lengths, keys, "left")


def joinable(pairs: DataFrame) -> DataFrame:
    """query_id and track: every member of the track scores enough and is of like length. pairs: query_id, track, score, length_diff."""
    return pairs.groupBy("query_id", "track").agg(F.bool_and((F.col("score") >= MEMBER_SCORE) & (F.col("length_diff") <= LENGTH_BAND)).alias("ok")).where("ok").drop("ok")


def mergeable(pairs: DataFrame) -> DataFrame:
    """Of track_pairs(), those whose worst score and largest difference of length allow a merge."""
    return pairs.where((F.col("score") >= MEMBER_SCORE) & (F.col("length_diff") <= LENGTH_BAND))


def assign(matches: DataFrame, allowed: DataFrame, track_score: float = TRACK_SCORE, same_score: float = SAME_SCORE) -> DataFrame:
    """query_id, track, and id where the match is so close that the fingerprint itself is known. matches: query_id, id, track, score; allowed: query_id, track.

    Of a track only its best match counts; the first allowed track, by score and then id, wins."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = matches.where(F.col("score") > track_score).join(allowed, ["query_id", "track"], "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("query_id", "track", F.when(F.col("score") > same_score, F.col("id")).alias("id"))


def name_scores(names: DataFrame, group: str, key: str) -> DataFrame:
    """group, key and score: how well a name (name, weight) agrees with its group's others, as the share of the group's weight on its runs of four characters. Weights meet by run, summed before the shuffle."""
    rows = names.select(group, key, "weight", F.explode(tx.grams(F.col("name"))).alias("gram"))
    weights = rows.groupBy(group, "gram").agg(F.sum("weight").alias("w"))
    total = weights.groupBy(group).agg(F.sum("w").alias("total"))
    scored = rows.join(weights, [group, "gram"]).groupBy(group, key).agg(F.sum("w").alias("sum"))
    return scored.join(total, group).select(group, key, (F.col("sum") / F.col("total")).alias("score"))


def outliers(scored: DataFrame, group: str, key: str) -> DataFrame:
    """group and key of links (score, sources, manual) that score low with few sources in their group, but well elsewhere, and that nobody enabled by hand."""
    top = scored.groupBy(group).agg(F.max("sources").alias("top"))
    good = scored.where(F.col("score") > GOOD_SCORE).select(F.col(key), F.col(group).alias("elsewhere")).groupBy(key).agg(F.count_distinct("elsewhere").alias("good"))
    # A low score is never among the good ones, so any good group is another one.
    low = scored.where((F.col("score") < LOW_SHARE) & ~F.col("manual")).join(top, group).where(F.col("sources") < LOW_SHARE * F.col("top"))
    return low.join(good, key, "left_semi").select(group, key)


def merge_groups(pairs: DataFrame) -> DataFrame:
    """track and group of tracks that may merge, of pairs (a, b; a < b): each track follows the largest one before it that it pairs with, and its group is where that ends. Tracks that only others follow are their own group."""
    before = pairs.where("a < b").groupBy(F.col("b").alias("id")).agg(F.max("a").alias("target"))
    led = closure(before).select(F.col("id").alias("track"), F.col("target").alias("group"))
    return led.unionByName(led.select(F.col("group").alias("track"), "group").distinct())
