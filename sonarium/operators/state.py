"""Changes of state, as functions from a snapshot and a delta to a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.sources.tables import Scratch


def add_counts(state: DataFrame, delta: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Upsert that adds: counters of equal keys are summed, new keys are inserted."""
    columns = [*keys, *counts]
    return state.select(columns).unionByName(delta.select(columns)).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counts])


class Cycle(ValueError):
    """Redirects lead in a circle."""


class Ambiguous(ValueError):
    """A row is sent to two places."""


def numbered(rows: DataFrame, keys: list[str], buckets: int = 64, per_bucket: int = 32) -> DataFrame:
    """rows with n, from 1 without gaps, ascending in the order of the keys (nulls first).

    The keys are cut into ranges by the keys of a sample, those of the least hashes. Ranges are numbered apart and then moved by the sizes
    of those before, so no task sorts all keys; what is broadcast is one row of edges, and one of a size for each range. A row finds its
    range in as many comparisons as the number of ranges has bits."""
    key = F.struct(*keys)
    sample = rows.select(key.alias("key_")).orderBy(F.xxhash64("key_")).limit(buckets * per_bucket)
    held = sample.agg(F.array_sort(F.collect_list("key_")).alias("s"))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / buckets))
    edges = held.select(F.filter("s", lambda _, i: (i > 0) & (i % step == 0)).alias("edges_"))
    dealt = rows.crossJoin(F.broadcast(edges)).withColumn("bucket_", F.lit(0))
    # A column for each halving: as plain comparisons these are compiled, which a function over the edges is not.
    for step in (1 << i for i in reversed(range((buckets - 1).bit_length()))):
        dealt = dealt.withColumn("bucket_", F.col("bucket_") + F.when(F.get("edges_", F.col("bucket_") + (step - 1)) <= key, step).otherwise(0))
    dealt = dealt.drop("edges_")
    sizes = dealt.groupBy("bucket_").agg(F.count("*").alias("size"))
    before = sizes.select("bucket_", (F.sum("size").over(Window.orderBy("bucket_")) - F.col("size")).alias("before_"))
    placed = dealt.withColumn("place_", F.row_number().over(Window.partitionBy("bucket_").orderBy(*[F.col(k).asc_nulls_first() for k in keys])))
    return placed.join(F.broadcast(before), "bucket_").withColumn("n", F.col("place_") + F.col("before_")).drop("bucket_", "place_", "before_")


def closure(redirects: DataFrame) -> DataFrame:
    """id and target of redirects (id, target) with each target followed to where no redirect leads on.

    All pointers jump at once, over twice as many hops each round, so there are about as many rounds as the longest chain's
    length has bits. Cycle if one leads back to itself, Ambiguous if one has two targets: both are seen before anything
    is changed. Null targets are no redirects. The rows are written to the shared folder after each round."""
    held = redirects.where("target is not null").select("id", "target").distinct()
    with Scratch(redirects.sparkSession) as scratch:
        held = scratch.keep(held, "redirects")
        if not held.groupBy("id").count().where("count > 1").isEmpty():
            raise Ambiguous("a redirect has two targets")
        for _ in range(held.count().bit_length() + 2):
            if not held.where("id = target").isEmpty():
                raise Cycle("redirects lead in a circle")
            on = held.select(F.col("id").alias("target"), F.col("target").alias("on_"))
            jumped = scratch.keep(held.join(on, "target", "left").select("id", F.coalesce("on_", "target").alias("target"), F.col("on_").isNotNull().alias("moved")), "redirects")
            held = jumped.select("id", "target")
            if jumped.where("moved").isEmpty():
                return scratch.keep(held, "closure", outlive=True)
    raise Cycle("redirects lead in a circle")


def find_or_insert(state: DataFrame, names: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """The state with a row for each new key; ids continue from the largest, without gaps, in the order of the keys. Null keys meet null keys."""
    same = [state[k].eqNullSafe(F.col(f"new_{k}")) for k in keys]
    asked = names.select(keys).distinct().withColumnsRenamed({k: f"new_{k}" for k in keys})
    new = asked.join(state.select(keys), same, "left_anti").withColumnsRenamed({f"new_{k}": k for k in keys})
    top = state.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("top")).scalar()
    given = numbered(new, keys).select((F.col("n") + top).alias(id_column), *keys)
    return state.select(id_column, *keys).unionByName(given)


def flattened(tracks: DataFrame) -> DataFrame:
    """tracks (id, new_id) with chains made one hop: every redirect leads where no other leads on; see closure()."""
    to = closure(tracks.select("id", F.col("new_id").alias("target")))
    return tracks.drop("new_id").join(to.select("id", F.col("target").alias("new_id")), "id", "left").select(tracks.columns)


def resolve(tracks: DataFrame) -> DataFrame:
    """id and target: redirects are one hop deep."""
    return tracks.select("id", F.coalesce("new_id", "id").alias("target"))


def forward(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """A watermark that only moves forward."""
    return old.select(column).unionByName(new.select(column)).agg(F.max(column).alias(column))


def keep_first(rows: DataFrame, content: str, key: str) -> DataFrame:
    """key and canonical: the smallest key of equal content."""
    first = rows.groupBy(content).agg(F.min(key).alias("canonical"))
    return rows.select(key, content).join(first, content).select(key, "canonical")


def inserted_once(state: DataFrame, new: DataFrame, content: str, key: str) -> DataFrame:
    """The state after an insert that does nothing where the content is there: of new rows of equal content the one of the smallest key goes in."""
    first = new.groupBy(content).agg(F.min_by(F.struct(*[c for c in state.columns if c != content]), key).alias("r")).select(content, "r.*")
    return state.unionByName(first.join(state.select(content), content, "left_anti").select(state.columns))


def canonical(rows: DataFrame, content: str = "content", gid: str = "gid") -> DataFrame:
    """id and canonical of rows (id, gid, content): of equal content the smallest id that has a gid, else the smallest id."""
    best = rows.groupBy(content).agg(F.coalesce(F.min(F.when(F.col(gid).isNotNull(), F.col("id"))), F.min("id")).alias("canonical"))
    return rows.select("id", content).join(best, content).select("id", "canonical")


def repoint(links: DataFrame, moved: DataFrame, column: str, keys: list[str], counts: list[str]) -> DataFrame:
    """Links whose column follows moved (id, canonical), with counts of links that became equal summed."""
    to = moved.where("id <> canonical").select(F.col("id").alias(column), "canonical")
    now = links.join(to, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")
    return now.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counts])


def drain(counters: DataFrame, applied: DataFrame, keys: list[str], known: DataFrame, owner: str) -> DataFrame:
    """Counters left when some were applied: lowered by what was, gone at zero; those of unknown owners are discarded."""
    n = [c for c in counters.columns if c not in keys][0]
    left = counters.select(*keys, n).unionByName(applied.select(*keys, (-F.col(n)).alias(n))).groupBy(*keys).agg(F.sum(n).cast("long").alias(n)).where(F.col(n) > 0)
    return left.join(known.select(owner).distinct(), owner, "left_semi").select(*keys, n)


def partitions(months: DataFrame, today: Column, ahead: int = 12, behind: int = 2) -> DataFrame:
    """month and action: months to create, from this one up to some ahead, and present ones to drop, more than some behind."""
    this = F.trunc(today, "MM")
    due = months.sparkSession.range(ahead + 1).select(F.add_months(this, F.col("id").cast("int")).alias("month"))
    create = due.join(months.select("month"), "month", "left_anti").select("month", F.lit("create").alias("action"))
    return create.unionByName(months.where(F.col("month") < F.add_months(this, -behind)).select("month", F.lit("drop").alias("action")))
