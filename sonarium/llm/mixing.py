"""Mixing sources to target weights, with DataFrame functions only.

Source shares p are raised to an exponent: weight ~ p ** a. At 1 the sources stay as they come, towards 0 they
become alike, beyond 1 large ones gain. The weights' entropy falls as the exponent grows, so the exponent of a
target entropy is bisected, in a bracket that is doubled until it holds the target. Where a source would then
be repeated more often than allowed, the exponent is bisected back towards 1, where all are repeated alike. A
source's budget is spent on whole epochs and one partial epoch. Each epoch visits the source's blocks (ranges
of a row hash) in an order of its own; the row at which the budget ends is found digit by digit of the hash,
so no window holds a source's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.storage import checkpointed

BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
#: Tables of sources up to this many rows go to the driver, or to all executors; larger ones are joined by shuffle.
SMALL = 100_000


def word_count(text: str = "text") -> Column:
    """Tokens of a text: runs of characters that are not white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


#: Beyond this exponent the largest sources have all the weight that doubles can tell.
LARGEST_EXPONENT = 4096.0


@dataclass(frozen=True)
class Mix:
    """exponent, budget in tokens, the weights' entropy as a share of that of equal weights, the repeats of the
    source that is repeated most, and which rule set the exponent: "entropy", "repeats" or "end" (no exponent
    reaches so low an entropy, as the largest sources are alike)."""

    exponent: float
    budget: float
    entropy: float
    repeats: float
    rule: str


@dataclass(frozen=True)
class Shares:
    """Sums over sources at an exponent, with shares taken relative to the largest one, so that no power is lost to rounding."""

    norm: float
    logs: float
    most: float
    least: float


def bisect_exponent(sums: Callable[[float], Shares], target_entropy: float, max_repeats: float, budget: float | None, total: float, largest: float, count: int, steps: int = 80) -> Mix:
    """sums(a), with r = p / largest share: the sums of r ** a and of r ** a * ln(r), and the largest and smallest r ** (a - 1).

    target_entropy is a share of ln(count). budget: tokens to emit, or None for the least with which every
    source is seen whole. largest: the tokens of the largest source."""

    def look(a: float) -> tuple[float, float, float]:
        """Entropy, most repeats and budget."""
        s = sums(a)
        entropy = math.log(s.norm) - a * s.logs / s.norm
        spent = s.norm * largest / s.least if budget is None else budget
        return entropy, spent * s.most / s.norm / largest, spent

    def edge(inside: float, outside: float, holds: Callable[[float], bool]) -> float:
        """The last exponent on the way from inside, where the rule holds, to outside, where it does not."""
        for _ in range(steps):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if holds(mid) else (inside, mid)
        return inside

    def enough(a: float) -> bool:
        return look(a)[0] >= goal

    def allowed(a: float) -> bool:
        return look(a)[1] <= max_repeats * (1 + 1e-12)

    whole = math.log(count) if count > 1 else 0.0
    goal = target_entropy * whole - 1e-12
    high, rule = 1.0, "entropy"
    while count > 1 and high < LARGEST_EXPONENT and enough(high):
        high *= 2
    if count == 1 or look(0.0)[0] - look(high)[0] < 1e-12:  # one source, or all alike: every exponent is the same
        a = 1.0
    elif enough(high):
        a, rule = high, "end"
    else:
        a = edge(0.0, high, enough)
    if not allowed(a):
        a, rule = (edge(1.0, a, allowed) if allowed(1.0) else 1.0), "repeats"
    entropy, repeats, spent = look(a)
    if repeats > max_repeats:  # even the shares as they come would repeat too often, or a rounding short of it
        spent, repeats = spent * max_repeats / repeats, max_repeats
    return Mix(a, spent, entropy / whole if whole else 1.0, repeats, rule)


def fit_mix(sources: DataFrame, target_entropy: float, max_repeats: float, budget: float | None) -> Mix | None:
    """The exponent for a table of source_key and tokens; None where no source has a token."""
    held = sources.where("tokens > 0")
    one = held.agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.max("tokens").alias("largest")).first()
    if not one.n:
        return None
    if one.n <= SMALL:
        share = sorted(r.tokens / one.largest for r in held.select("tokens").collect())
        logs = [math.log(x) for x in share]

        def sums(a: float) -> Shares:
            w = [math.exp(a * x) for x in logs]
            ends = [math.exp((a - 1) * x) for x in (logs[0], logs[-1])]
            return Shares(math.fsum(w), math.fsum(x * y for x, y in zip(w, logs, strict=True)), max(ends), min(ends))
    else:
        log = F.log(F.col("tokens") / F.lit(float(one.largest)))

        def sums(a: float) -> Shares:
            w, end = F.exp(log * a), F.exp(log * (a - 1))
            return Shares(*held.agg(F.sum(w), F.sum(w * log), F.max(end), F.min(end)).first())

    return bisect_exponent(sums, target_entropy, max_repeats, budget, float(one.total), float(one.largest), one.n)


def _digit(level: int) -> Column:
    return F.shiftrightunsigned(F.col("mix_key"), 64 - BLOCK_BITS * level).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def block_order(seed: int, epoch: Column | str, block: Column | str) -> Column:
    """The place of a block in an epoch of its source."""
    return F.xxhash64(F.lit(seed), F.lit("block"), epoch, "mix_source", block)


def _cut(totals: DataFrame, order: list[Column], rest: str) -> DataFrame:
    """By source: the first entry at which the running total exceeds what is left, and what is left before it."""
    w = Window.partitionBy("mix_source").orderBy(*order)
    run = totals.withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col(rest) - F.col("sum") + F.col("tokens")
    # One entry crosses the line: it has tokens, unlike those that follow it at the same total.
    return run.where((F.col("sum") > F.col(rest)) & (left >= 0)).select("mix_source", "entry", left.alias("left"))


def plan_sources(keyed: DataFrame, target_entropy: float, max_repeats: float, budget: float | None, seed: int) -> DataFrame:
    """One row per source: mix_source, weight, whole epochs, block, sub-block and key at which the partial epoch ends, and the mix's exponent, entropy and rule. keyed: mix_source, mix_tokens, mix_key."""
    digits = keyed.withColumns({"d1": _digit(1), "d2": _digit(2)})
    blocks = checkpointed(digits.groupBy("mix_source", "d1").agg(F.sum("mix_tokens").alias("tokens")))
    sources = blocks.groupBy("mix_source").agg(F.sum("tokens").alias("tokens"))
    mix = fit_mix(sources, target_entropy, max_repeats, budget)
    if mix is None:
        nothing = {"b1": "int", "b2": "int", "b3": "long", "exponent": "double", "entropy": "double", "rule": "string"}
        return sources.select("mix_source", F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    held = F.col("tokens") > 0
    largest = float(sources.agg(F.max("tokens")).first()[0])
    power = F.exp(F.log(F.col("tokens") / F.lit(largest)) * F.lit(mix.exponent))
    total = sources.where(held).agg(F.sum(power)).first()[0]
    weighed = sources.withColumn("weight", F.when(held, power / F.lit(total)).otherwise(0.0))
    spend = F.floor(F.col("weight") * F.lit(mix.budget * (1 + 1e-9)) + F.lit(1e-6)).cast("long")  # the products of doubles may fall short of whole tokens
    epochs = F.when(held, F.floor(spend / F.col("tokens"))).otherwise(1).cast("long")
    rest = F.when(held, spend - epochs * F.col("tokens")).otherwise(-1)
    base = checkpointed(weighed.select("mix_source", "tokens", "weight", epochs.alias("epochs"), rest.cast("long").alias("rest")))

    first = _cut(blocks.withColumnRenamed("d1", "entry").join(base.drop("tokens"), "mix_source"), [block_order(seed, F.col("epochs"), F.col("entry")), F.col("entry")], "rest")
    first = first.select("mix_source", F.col("entry").alias("b1"), F.col("left").alias("left1"))
    inner = digits.join(F.broadcast(first) if _small(first) else first, "mix_source").where("d1 = b1")
    second = _cut(inner.groupBy("mix_source", "left1", F.col("d2").alias("entry")).agg(F.sum("mix_tokens").alias("tokens")), [F.col("entry")], "left1")
    second = second.select("mix_source", F.col("entry").alias("b2"), F.col("left").alias("left2")).join(first.select("mix_source", "b1"), "mix_source")
    last = digits.join(F.broadcast(second) if _small(second) else second, "mix_source").where("d1 = b1 and d2 = b2")
    third = _cut(last.groupBy("mix_source", "left2", F.col("mix_key").alias("entry")).agg(F.sum("mix_tokens").alias("tokens")), [F.col("entry")], "left2")
    cuts = second.select("mix_source", "b1", "b2").join(third.select("mix_source", F.col("entry").alias("b3")), "mix_source", "left")
    reached = {"exponent": F.lit(mix.exponent), "entropy": F.lit(mix.entropy), "rule": F.lit(mix.rule)}
    return checkpointed(base.drop("rest", "tokens").join(cuts, "mix_source", "left").withColumns(reached))


def _small(sources: DataFrame) -> bool:
    return sources.limit(SMALL + 1).count() <= SMALL


def mix_copies(docs: DataFrame, target_entropy: float = 0.98, max_repeats: float = 4.0, budget: float | None | str = "input", passes: float = 1.0, seed: int = 1) -> DataFrame:
    """The input's rows with mix_source, mix_tokens, mix_key, mix_block, mix_copies, mix_weight, mix_epochs, and what was reached over all (mix_exponent, mix_entropy, mix_rule; see Mix); mix_copies 0 means that a row is left out.

    budget: tokens; "input" for `passes` times as many as the input has; None for the least with which every
    source is seen whole. A source's tokens never exceed its budget. Rows alike in id and text stand or fall
    together. Null sources are one source. Rows of a source without tokens are emitted once. Input columns
    whose names begin with mix_ are replaced; all other names are free."""
    names = [c for c in docs.columns if not c.startswith("mix_")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("mix_row"), source_key().alias("mix_source"), word_count().alias("mix_tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix_key"))
    slim = checkpointed(keyed.select("mix_source", "mix_tokens", "mix_key"))
    if budget == "input":
        budget = passes * (slim.agg(F.sum("mix_tokens").cast("double").alias("t")).first().t or 0.0)
    plan = plan_sources(slim, target_entropy, max_repeats, budget, seed)
    joined = keyed.join(F.broadcast(plan) if _small(plan) else plan, "mix_source").withColumn("mix_block", _digit(1))
    order = lambda b: block_order(seed, F.col("epochs"), b)
    before = F.struct(order(F.col("mix_block")), F.col("mix_block")) < F.struct(order(F.col("b1")), F.col("b1"))
    sub, unsigned = _digit(2), lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    within = F.col("mix_block").eqNullSafe(F.col("b1")) & ((sub < F.col("b2")) | ((sub == F.col("b2")) & (F.col("b3").isNull() | (unsigned("mix_key") < unsigned("b3")))))
    extra = F.coalesce(F.col("b1").isNotNull() & (before | within), F.lit(False))
    copies = (F.col("epochs") + extra.cast("long")).cast("int")
    own = [F.col("mix_row").getField(c).alias(c) for c in names]
    planned = [F.col(c).alias(f"mix_{c}") for c in ("weight", "epochs", "exponent", "entropy", "rule")]
    return joined.select(*own, "mix_source", "mix_tokens", "mix_key", "mix_block", copies.alias("mix_copies"), *planned)


def mix_stream(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """One row per emission: the input's columns, those of mix_copies() but the counts of copies and epochs, and mix_epoch and mix_order. Sorted by source, mix_epoch, mix_order, mix_block and mix_key it is the source's stream.

    Options, and what becomes of nulls, repeats and clashing names: see mix_copies()."""
    copies = mix_copies(docs, seed=seed, **options).where("mix_copies > 0")
    emitted = copies.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    return emitted.withColumn("mix_order", block_order(seed, F.col("mix_epoch").cast("long"), F.col("mix_block"))).drop("mix_copies", "mix_epochs")
