"""Similarity search: candidates by shared terms, exact scores and the best per query. The index itself is in index.py."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp
from sonarium.operators.index import BUCKETS, NEWEST, TermIndex, masked, new_index, packed, term_index, unpacked
from sonarium.sources.tables import Scratch  # noqa: F401

__all__ = ["BUCKETS", "NEWEST", "TermIndex", "masked", "new_index", "term_index"]

#: Candidates and the percentage of the best one's matches that they must exceed: a quick search, and a thorough one.
FAST, FULL = (10, 40), (20, 10)
#: What one request may ask for: fingerprints, tracks, and results of each.
MOST_FINGERPRINTS, MOST_TRACKS, MOST_RESULTS = 20, 100, 10
#: Results of an outside store that are looked at.
MOST_STORED = 100


#: Documents of a shard that a term must be in, at least, to be held back as a common one, if it is not so by its share.
COMMON = 20_000


def _ranked(counted: DataFrame, query: str, key: str, most: int, least_percent: int) -> DataFrame:
    """Of counts (query, key, matches) the first `most` of each query, above a percentage of its best."""
    of_query = Window.partitionBy(query)
    ranked = counted.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("matches"), key))).where(F.col("place") <= most)
    ranked = ranked.withColumn("best", F.max("matches").over(of_query))
    return ranked.where(F.col("matches") * 100 > F.col("best") * least_percent).select(query, key, "matches")


#: Postings of a shard, and terms of a block of queries, at most; bytes of the flags of common terms in a shard; shards are no smaller than this for the sake of idle cores.
SHARD, BLOCK, FLAGS, LEAST_SHARD = 1 << 23, 1 << 24, 1 << 26, 1 << 20
#: Terms asked for, up to which the index is filtered by them before it is dealt out.
FEW_TERMS = 200_000
#: Pairs near each other, up to which their ids go to all executors.
FEW_PAIRS = 1 << 20


#: Bytes of the rows of bits that are added up at a time.
ADDED = 1 << 21


def _looked_up(distinct: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values are among distinct ones in order, -1 for others; a part at a time, for the sake of memory."""
    out = np.full(len(values), -1, np.int32)
    for low in range(0, len(values) if len(distinct) else 0, 1 << 20):
        some = values[low : low + (1 << 20)]
        at = np.minimum(np.searchsorted(distinct, some), len(distinct) - 1)
        out[low : low + len(some)] = np.where(distinct[at] == some, at, -1)
    return out


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and where each value is among them. Values of a small range are looked up in a table."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    if high - low > 4 * len(values):
        distinct = np.unique(values)
        return distinct, _looked_up(distinct, values)
    there = np.zeros(high - low + 1, bool)
    for i in range(0, len(values), 1 << 20):
        there[values[i : i + (1 << 20)] - low] = True
    distinct = np.flatnonzero(there)
    table = np.zeros(len(there), np.int32)
    table[distinct] = np.arange(len(distinct))
    out = np.empty(len(values), np.int32)
    for i in range(0, len(values), 1 << 20):
        out[i : i + (1 << 20)] = table[values[i : i + (1 << 20)] - low]
    return distinct + low, out


class _Asked:
    """Terms asked for, in the order of their queries: a query's terms are places in the distinct ones."""

    def __init__(self, queries: np.ndarray, terms: np.ndarray):
        order = np.argsort(queries, kind="stable")
        self.queries, begin = np.unique(queries[order], return_index=True)
        self.edges = np.append(begin, len(order))
        self.terms = np.unique(terms)
        self.places = _looked_up(self.terms, terms[order])


def _planes(rows: np.ndarray) -> list[np.ndarray]:
    """How many of the rows have each bit, as binary digits, the lowest first: three rows become a sum and a carry. The rows are written over."""
    digits = []
    while len(rows):
        carries = [rows[:0]]
        while len(rows) > 1:
            m, rest = divmod(len(rows), 3)
            if m:
                a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                half = a ^ b
                carry = a & b
                carry |= half & c
                np.bitwise_xor(half, c, out=a)
                rows[m : m + rest] = rows[3 * m :]
                rows = rows[: m + rest]
            else:
                carry = rows[:1] & rows[1:]
                rows = rows[:1] ^ rows[1:]
            carries.append(carry)
        digits.append(rows[0])
        rows = np.concatenate(carries)
    return digits


def _bits(words: np.ndarray, most: int) -> np.ndarray:
    """The places of set bits, the first `most` at most."""
    at = np.flatnonzero(words)[:most]
    word, bit = np.nonzero(np.unpackbits(words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return (at[word] * 64 + bit)[:most]


def _highest(digits: list[np.ndarray], inside: np.ndarray, most: int) -> np.ndarray:
    """Of the places inside, a row of them for each query, the `most` with the highest counts: the first ones where these are equal, and none of count 0. Places go on from row to row."""
    above, equal, value = np.zeros_like(inside), inside, np.zeros(len(inside), bool)
    for digit in digits[::-1]:
        digit = digit.reshape(inside.shape)
        have = equal & digit
        more = above | have
        many = np.bitwise_count(more).sum(axis=1) > most
        value |= many
        above = np.where(many[:, None], above, more)
        equal = np.where(many[:, None], have, equal & ~digit)
    first = [_bits(above.reshape(-1), above.size * 64)]
    free = most - np.bitwise_count(above).sum(axis=1)
    for i in np.flatnonzero(value & (free > 0)):
        first.append(_bits(equal[i], int(free[i])) + i * 64 * inside.shape[1])
    return np.concatenate(first)


def _count(asked: _Asked, held: list[np.ndarray], most: int, common: int, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shard_counts(), of postings held, keys and terms, which are let go on the way."""
    at = _looked_up(asked.terms, held.pop())
    known = at >= 0
    if not known.any():
        return (np.zeros(0, np.int64),) * 3
    keys, places = _places(held.pop()[known])
    own, at = _places(at[known])  # of the terms asked for, those of the shard
    del known
    local = np.full(len(asked.terms), -1, np.int32)
    local[own] = np.arange(len(own))
    sizes = np.bincount(at, minlength=len(own))
    edges = np.append(0, np.cumsum(sizes))
    places = places[np.argsort(at, kind="stable")]
    del at
    words = -(-len(keys) // 64)
    span = 64 * words
    chosen = np.argsort(-sizes, kind="stable")[: FLAGS // (8 * words)]
    chosen = chosen[sizes[chosen] > min(common, len(keys) // 1024)]
    flags = np.zeros((len(chosen) + 1, words), np.uint64)  # the last row has no bits
    row = np.zeros(span, np.uint8)
    for i, t in enumerate(chosen):
        row[places[edges[t] : edges[t + 1]]] = 1
        flags[i] = np.packbits(row, bitorder="little").view(np.uint64)
        row[places[edges[t] : edges[t + 1]]] = 0
    row_of = np.full(len(own), -1)
    row_of[chosen] = np.arange(len(chosen))
    row[: len(keys)] = 1
    inside = np.packbits(row, bitorder="little").view(np.uint64)
    out, low = [(np.zeros(0, np.int64),) * 3], 0
    while low < len(asked.queries):
        # Queries whose rows are added up together.
        high = max(low + 1, int(np.searchsorted(asked.edges, asked.edges[low] + ADDED // (8 * words), "right")) - 1)
        some = high - low
        mine = local[asked.places[asked.edges[low] : asked.edges[high]]]
        owner = np.repeat(np.arange(some), np.diff(asked.edges[low : high + 1]))[mine >= 0]
        mine = mine[mine >= 0]
        rows = row_of[mine]
        each = np.bincount(owner[rows >= 0], minlength=some)
        of_query = np.full((int(each.max()), some), len(chosen))
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        of_query[nth, owner[rows >= 0]] = rows[rows >= 0]
        rare, owner = mine[rows < 0], owner[rows < 0]
        at = np.repeat(edges[rare] - (np.cumsum(sizes[rare]) - sizes[rare]), sizes[rare]) + np.arange(sizes[rare].sum())
        rare, times = np.unique(places[at] + np.repeat(owner, sizes[rare]) * span, return_counts=True)
        within = np.repeat(inside[None], some, axis=0)
        if earlier:
            ends = np.searchsorted(keys, asked.queries[low:high])
            within = np.packbits(np.arange(span) < ends[:, None], axis=1, bitorder="little").view(np.uint64)
            before = rare % span < ends[rare // span]
            rare, times = rare[before], times[before]
        digits = _planes(flags[of_query].reshape(len(of_query), -1))
        # What is ahead by common terms stays ahead of all that has no rare one.
        first = _highest(digits, within, most)
        if len(rare):
            seen = rare[np.minimum(np.searchsorted(rare, first), len(rare) - 1)] == first
            first = np.concatenate([rare, first[~seen]])
        n = np.zeros(len(first), np.int64)
        n[: len(rare)] = times
        for j, digit in enumerate(digits):
            n += ((digit[first >> 6] >> (first & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
        out.append(_first(asked.queries[low + first // span], keys[first % span], n, most))
        low = high
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _first(queries: np.ndarray, keys: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the `most` keys of the highest counts, the lowest keys where these are equal."""
    order = np.lexsort((keys, -n, queries))
    queries = queries[order]
    begin = np.flatnonzero(np.append(True, queries[1:] != queries[:-1])[: len(queries)])
    kept = np.arange(len(queries)) - np.repeat(begin, np.diff(np.append(begin, len(queries)))) < most
    return queries[kept], keys[order][kept], n[order][kept]


def shard_counts(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], most: int, common: int, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and matches: of a shard's postings (keys, terms) the first `most` of each query, of some (queries, terms).

    Terms of more than `common` documents, or of one in a thousand, are rows of bits, as far as these have room, and the rows of a query are added up as binary
    digits, 64 documents at once. The few documents of its other terms are counted by themselves."""
    return _count(_Asked(*asked), list(held), most, common, earlier)


def _batches(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(dict(zip(("q_", "k_", "n_"), rows, strict=True))).to_batches(max_chunksize=1 << 16)


def candidates(
    queries: DataFrame, index: DataFrame | TermIndex, key: str = "id", query: str = "query_id", most: int = FULL[0], least_percent: int = FULL[1],
    common: int = COMMON, earlier: bool = False,
) -> DataFrame:
    """query, key and matches: for each query, the fingerprints that share terms, above a percentage of the best, the first `most` of them.

    queries: query, term; index: a stored one, or key and term, each pair once; queries and keys are whole numbers. With `earlier`, only fingerprints
    whose key is below the query's count. The documents are dealt to shards, and the shards to a group for each core, which takes one after another. The queries
    come to each group, in blocks where they are many; both travel packed, see packed(). A shard counts all terms of a query in its documents, and
    the group keeps the first `most` of its shards, so what shares a term never becomes a row: of a query there are `most` rows for each group, however many
    documents there are. Every document is counted, and no row is cut off that could be in the result. Terms of more than `common` documents of a
    shard are held back from its postings; see shard_counts()."""
    every = index.postings().drop("segment") if isinstance(index, TermIndex) else index
    if every.isEmpty():  # then no term of a query need be worked out
        of_key = every.schema["id" if isinstance(index, TermIndex) else key].dataType
        return queries.limit(0).select(query, F.lit(None).cast(of_key).alias(key), F.lit(None).cast("long").alias("matches"))
    asked = queries.select(query, "term").distinct().where(F.col(query).isNotNull() & F.col("term").isNotNull())
    held = index.holding(asked) if isinstance(index, TermIndex) else index
    if key != "id" and isinstance(index, TermIndex):
        held = held.withColumnRenamed("id", key)
    terms = asked.select("term").distinct()
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        held = held.join(F.broadcast(terms), "term", "left_semi")
    kinds = {c: df.schema[c].dataType for c, df in ((query, asked), (key, held))}
    cores = queries.sparkSession.sparkContext.defaultParallelism
    size = held.count()
    shards = max(-(-size // SHARD), min(cores, -(-size // LEAST_SHARD)), 1)
    blocks = max(-(-asked.count() // BLOCK), 1)
    groups = min(cores, shards)
    # A cell is a group of shards with a block of queries, which come before the shards.
    part = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = F.col("block_") * groups + F.col("group_")
    left = packed(asked.select(part(query, blocks), query, "term")).select(F.col("part").alias("block_"), copies(groups).alias("group_"), F.lit(-1).alias("shard_"), "n", "keys", "terms")
    right = packed(held.select(part(key, shards), key, "term")).select(copies(blocks).alias("block_"), (F.col("part") % groups).alias("group_"), F.col("part").alias("shard_"), "n", "keys", "terms")
    cells = left.unionByName(right).select(cell.alias("cell_"), "shard_", "n", "keys", "terms")
    cells = cells.repartitionById(blocks * groups, "cell_").sortWithinPartitions("cell_", "shard_")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),) * 3
        asked, best, cell = None, none, None
        for at, keys, terms in unpacked(batches, ["cell_", "shard_"]):
            if at[0] != cell:
                yield from _batches(best)
                asked, best, cell = None, none, at[0]
            if at[1] < 0:
                asked = _Asked(keys, terms)
            elif asked is not None:
                held = [keys, terms]
                del keys, terms
                found = _count(asked, held, most, common, earlier)
                best = _first(*[np.concatenate(x) for x in zip(best, found, strict=True)], most)
            keys = terms = None  # the next shard takes their place
        yield from _batches(best)

    counted = cells.mapInArrow(count, "q_ long, k_ long, n_ long")
    counted = counted.select(F.col("q_").cast(kinds[query]).alias(query), F.col("k_").cast(kinds[key]).alias(key), F.col("n_").alias("matches"))
    return _ranked(counted, query, key, most, least_percent)


def tail_candidates(queries: DataFrame, corpus: DataFrame, newest: int) -> DataFrame:
    """query_id and id of the fingerprints that the index lacks yet (above the newest indexed id) and that share a query term. queries, corpus: as for search()."""
    late = term_index(corpus.where(F.col("id") > newest))
    return term_index(queries, "query_id").join(late, "term").select("query_id", "id").distinct()


def scored(queries: DataFrame, corpus: DataFrame, found: DataFrame, least_score: float, length_band: int | None, limit: int, scratch: Scratch | None = None) -> DataFrame:
    """Exact scores of candidates (query_id, id): those within the length band and above least_score; of a query the first `limit`, and of these the first of each group.

    With scratch, what is near is kept there first, and the hashes of other documents don't travel."""
    band = F.col("band") if "band" in queries.columns else F.lit(length_band).cast("int")
    asked = queries.select("query_id", F.col("hashes").alias("a"), F.col("length").alias("a_length"), band.alias("a_band"))
    held = corpus.select("id", "group", F.col("hashes").alias("b"), F.col("length").alias("b_length"))
    # The band is looked at before the hashes travel.
    near = found.join(asked.select("query_id", "a_length", "a_band"), "query_id").join(held.select("id", "group", "b_length"), "id")
    near = near.where(F.col("a_band").isNull() | (F.abs(F.col("a_length") - F.col("b_length")) <= F.col("a_band")))
    near, hashes = near.select("query_id", "id", "group"), held.select("id", "b")
    if scratch is not None:
        near = scratch.keep(near, "near")
        if near.count() <= FEW_PAIRS:
            hashes = hashes.join(F.broadcast(near.select("id").distinct()), "id", "left_semi")
    pairs = near.join(asked.select("query_id", "a"), "query_id").join(hashes, "id")
    good = pairs.select("query_id", "id", "group", fp.compare("a", "b").alias("score")).where(F.col("score") > least_score)
    return first_of_groups(good, limit)


def first_of_groups(scored: DataFrame, limit: int) -> DataFrame:
    """Of rows (query_id, id, group, score) the first `limit` of each query by score and id; then of each group its first one, with its rank among those.

    The limit is on fingerprints, as in the service: where they are many of one track, fewer tracks come out."""
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = scored.withColumn("n", F.row_number().over(of_query)).where(F.col("n") <= limit)
    of_group = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "id")
    one = first.withColumn("g", F.row_number().over(of_group)).where("g = 1").withColumn("rank", F.row_number().over(of_query))
    return one.select("query_id", "id", "group", "score", "rank")


def search(
    queries: DataFrame, corpus: DataFrame, most: int = FULL[0], least_percent: int = FULL[1], least_score: float = 0.4, length_band: int | None = 7,
    limit: int = MOST_RESULTS, index: DataFrame | TermIndex | None = None, newest: int | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """query_id, id, group, score and rank. queries: query_id, hashes, length, and a length band of their own (band) if they have one; corpus: id, hashes, length, and group (its track).

    index: the terms of the corpus, stored or as rows, if kept; else they are made. With the newest indexed id, fingerprints above it
    are looked for by their terms directly, and all candidates are scored together. With scratch, the terms asked for and what is near are kept there, and made once;
    the result reads them."""
    terms = term_index(corpus, every_term=True) if index is None else index
    asked = term_index(queries, "query_id") if scratch is None else scratch.keep(term_index(queries, "query_id"), "asked")
    found = candidates(asked, terms, most=most, least_percent=least_percent).select("query_id", "id")
    if newest is not None:
        found = found.unionByName(tail_candidates(queries, corpus, newest)).distinct()
    return scored(queries, corpus, found, least_score, length_band, limit, scratch)


def search_stored(
    results: DataFrame, queries: DataFrame, corpus: DataFrame, least_score: float = 0.4, length_band: int | None = 7, limit: int = MOST_RESULTS, most: int = MOST_STORED
) -> DataFrame:
    """Results (query_id, id, score) of an outside store, as search() gives them. queries: query_id, length; corpus: id, length, group.

    Of each query the first `most` by score above least_score count, within the length band that every search has. The limit
    then takes the smallest ids, whose scores decide the order alone, as the service's own query does."""
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    held = results.where(F.col("score") > least_score).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).drop("n")
    near = held.join(corpus.select("id", "group", F.col("length").alias("b_length")), "id").join(queries.select("query_id", F.col("length").alias("a_length")), "query_id")
    if length_band is not None:
        near = near.where(F.abs(F.col("a_length") - F.col("b_length")) <= length_band)
    low = Window.partitionBy("query_id").orderBy("id")
    kept = near.withColumn("n", F.row_number().over(low)).where(F.col("n") <= limit).select("query_id", "id", "group", "score")
    return first_of_groups(kept, limit)


def lookup(queries: DataFrame, wanted: DataFrame, corpus: DataFrame, tracks: DataFrame, fast: bool = False, **options) -> DataFrame:
    """query_id, result (a track's gid) and score: fingerprints that were searched for, and tracks that were asked for by gid (wanted: query_id, gid).

    tracks: id, gid, new_id. A track asked for has the score 1, and is called as it was asked for even where it
    leads elsewhere; track_id is where it leads. Each query has MOST_RESULTS results at most."""
    most, percent = FAST if fast else FULL
    found = search(queries, corpus, most=most, least_percent=percent, **options)
    known = tracks.select(F.col("id").alias("group"), "gid")
    by_print = found.join(known, "group").select("query_id", F.col("gid").alias("result"), F.col("group").alias("track_id"), "score")
    by_gid = wanted.join(tracks, "gid").select("query_id", F.col("gid").alias("result"), F.coalesce("new_id", "id").alias("track_id"), F.lit(1.0).alias("score"))
    return by_print.unionByName(by_gid)


class TooMany(ValueError):
    """A request asks for more than one may."""


def batch(fingerprints: list, gids: list, several: bool) -> tuple[list, list]:
    """What a request asks for: all its fingerprints and track ids, or without `several` the first of each; TooMany beyond what one may ask for."""
    if not several:
        return fingerprints[:1], [] if fingerprints else gids[:1]
    if len(fingerprints) > MOST_FINGERPRINTS or len(gids) > MOST_TRACKS:
        raise TooMany(f"{len(fingerprints)} fingerprints and {len(gids)} tracks")
    return fingerprints, gids


def empty_index(spark, buckets: int = BUCKETS) -> TermIndex:
    return new_index(spark, buckets=buckets)


def rows_within(df: DataFrame, seconds: float) -> list:
    """The rows of a small result, or none if it is not there in time; its jobs are then cancelled."""
    spark, tag = df.sparkSession, f"within-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        rows = df.collect()
        return [] if late.is_set() else rows
    except Exception:  # a cancelled job may surface as Spark's error, or as the gateway's
        if late.is_set():
            return []
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
