"""Exact top-k search by inner product, pruned with segment statistics from coarse to fine.

A vector is cut into 1, 2, 4, ... segments, down to one component each. With a segment's length L, means m and
deviations s, |q - x|^2 >= sum L ((m_q - m_x)^2 + (s_q - s_x)^2), and so, as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2,
the inner product is at most sum L (m_q m_x + s_q s_x). A pair whose bound stays under the k-th best score that
its query has so far is dropped; only survivors of all levels get exact inner products.

Rows of like coarse means lie in one block. A query first meets a block of its own kind, for a score to beat.
The statistics of whole blocks then tell which pairs of blocks may hold a better score, and only for these do
vectors travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import checkpointed

#: Rows of a block of queries and of candidates: a pair of blocks is one unit of work, of bounded memory.
QUERY_BLOCK, ROW_BLOCK = 8192, 8192
#: Queries and rows of a block that are compared at a time. The first rows are few: they give scores to beat.
QUERY_PART, FIRST_ROWS, ROW_PART = 256, 64, 2048
#: Segments whose means' signs name the kind of a vector (as many of them as the table fills with blocks), and segments of a block's statistics.
KIND_SEGMENTS, BLOCK_SEGMENTS = 16, 16
#: Blocks whose statistics are compared in one task.
META_BLOCK = 2048
#: Pairs are looked at one by one once at most this share is left; above it, whole matrices are cheaper.
FEW = 0.25
#: Inner products up to this size are exact in doubles.
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, both times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    sizes = np.diff([*edges, x.shape[1]])
    mean = np.add.reduceat(x, edges, axis=1) / sizes
    square = np.add.reduceat(x * x, edges, axis=1) / sizes
    return mean * np.sqrt(sizes), np.sqrt(np.maximum(square - mean * mean, 0) * sizes)


def levels(dims: int) -> list[int]:
    """Numbers of segments, doubling, below one for each component: there the bound would be the product itself."""
    out, n = [], 1
    while n < dims:
        out.append(n)
        n *= 2
    return out or [1]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of q with those of x, one to one; beyond 64 bits they stop at the limits of a long."""
    most = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < EXACT:
        return np.einsum("pd,pd->p", q, x).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(*r, strict=True)) for r in zip(q.tolist(), x.tolist(), strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in big], np.int64)


class Statistics:
    """Segment statistics of some rows, made level by level when they are first asked for."""

    def __init__(self, x: np.ndarray):
        self.x, self.held = x, {}

    def at(self, segments: int) -> np.ndarray:
        if segments not in self.held:
            self.held[segments] = np.concatenate(segment_stats(self.x, segments), axis=1)
        return self.held[segments]


def _survivors(q: Statistics, x: Statistics, part: slice, rows: slice, limit: np.ndarray, slack: np.ndarray, own: np.ndarray, k: int, tally: dict[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries of a part and rows of a part whose bounds reach the limit at every level.

    After a level each query's rows of the highest bounds are scored: their k-th best score may raise the limit."""
    base, span = rows.start, rows.stop - rows.start
    alive = np.ones((part.stop - part.start, span), bool)
    mine = np.flatnonzero((own >= base) & (own < rows.stop))
    alive[mine, own[mine] - base] = False
    i = j = None
    for n in levels(x.x.shape[1]):
        a, b = q.at(n)[part], x.at(n)[rows]
        if i is None:
            some = np.flatnonzero(alive.any(0))
            bound = np.where(alive[:, some], a @ b[some].T, -np.inf)
            if len(some) > 4 * k:
                first = np.argpartition(-bound, 2 * k, axis=1)[:, : 2 * k]
                score = np.einsum("qd,qsd->qs", q.x[part], x.x[base + some[first]])
                score[np.take_along_axis(bound, first, 1) == -np.inf] = -np.inf
                limit = np.maximum(limit, np.partition(score, k, axis=1)[:, k] - slack)
            alive[:, some] = bound >= limit[:, None]
            left = int(alive.sum())
            if left <= FEW * alive.size:
                i, j = np.nonzero(alive)
        else:
            keep = np.concatenate([np.einsum("pd,pd->p", a[i[s : s + 50_000]], b[j[s : s + 50_000]]) >= limit[i[s : s + 50_000]] for s in range(0, len(i), 50_000)]) if len(i) else np.zeros(0, bool)
            i, j = i[keep], j[keep]
            left = len(i)
        if tally is not None:
            tally[n] = tally.get(n, 0) + left
        if not left:
            break
    if i is None:
        i, j = np.nonzero(alive)
    return i, j + base


def block_topk(q_ids: np.ndarray, q: np.ndarray, beat: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, tally: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query its k best rows of x other than its own id, as far as they reach `beat`: query positions, row positions and scores.

    x_ids ascend, without repeats. tally, if given, counts the pairs that each level leaves."""
    n = len(x_ids)
    if not n or not len(q_ids):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(x_ids, q_ids), n - 1)
    own = np.where(x_ids[at] == q_ids, at, -1)
    slack = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max()) * 1e-9 + 1e-6
    q_stats, x_stats = Statistics(q), Statistics(x)
    out = []
    for low in range(0, len(q_ids), QUERY_PART):
        part = slice(low, min(low + QUERY_PART, len(q_ids)))
        size = part.stop - low
        best = np.full((size, k), NONE, np.int64)
        where = np.full((size, k), n, np.int64)
        stop = 0
        while stop < n:
            rows = slice(stop, min(n, stop + max(FIRST_ROWS, 8 * k) if not stop else stop + ROW_PART))
            stop = rows.stop
            limit = np.maximum(beat[part], best[:, -1].astype(np.float64)) - slack[part]
            i, j = _survivors(q_stats, x_stats, part, rows, limit, slack[part], own[part], k, tally)
            if not len(i):
                continue
            score = np.concatenate([_exact(q[low + i[s : s + 50_000]], x[j[s : s + 50_000]]) for s in range(0, len(i), 50_000)])
            # The k best so far and the new ones: by query, score descending, position ascending.
            held = where < n
            rows_of = np.concatenate([np.repeat(np.arange(size), k)[held.ravel()], i])
            scores = np.concatenate([best[held], score])
            places = np.concatenate([where[held], j])
            order = np.lexsort((places, ~scores, rows_of))
            rows_of, scores, places = rows_of[order], scores[order], places[order]
            rank = np.arange(len(rows_of)) - np.searchsorted(rows_of, rows_of)
            keep = rank < k
            best[rows_of[keep], rank[keep]] = scores[keep]
            where[rows_of[keep], rank[keep]] = places[keep]
        r, c = np.nonzero(where < n)
        out.append((r + low, where[r, c], best[r, c]))
    return tuple(np.concatenate([x[m] for x in out]) for m in range(3))


def pruned_shares(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, float]:
    """The share of all pairs that is left after each level, for a report; the finest level's pairs get exact scores."""
    tally: dict[int, int] = {}
    block_topk(q_ids, q, np.full(len(q_ids), -np.inf), x_ids, x, k, tally)
    return {n: tally.get(n, 0) / max(1, len(q_ids) * len(x_ids)) for n in levels(x.shape[1])}


def _floats(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).reshape(rows, -1) if rows else np.zeros((0, 1))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = _floats(table.column("x"), len(ids))
    beat = table.column("beat").to_numpy()[order] if "beat" in table.column_names else np.zeros(0)
    return ids[order], x[order], beat


def _prepared(vectors: DataFrame, scale: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id, dims, kind (signs of the means of a few segments) and x of the usable vectors, one row per id."""
    usable = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable)
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))
    again = checkpointed(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if not again.isEmpty():
        one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct(F.size("x").alias("dims"), "x")).alias("m")).select("vec_id", "m.x")
        rows = rows.join(again, "vec_id", "left_anti").unionByName(one)

    def kinds(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = value.values.to_numpy(zero_copy_only=False)
                mean, _ = segment_stats(x[None, :], min(KIND_SEGMENTS, len(x)))
                kind = np.packbits(np.append(mean[0] > 0, np.zeros(KIND_SEGMENTS - mean.shape[1], bool)))
                yield (key, len(x), int.from_bytes(kind.tobytes(), "big"), x.tolist()), 64 + 8 * len(x)

    return map_rows(rows, kinds, "vec_id LONG, dims INT, kind INT, x ARRAY<DOUBLE>")


_BLOCK = ["dims", "kind", "part"]


def _dealt(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """rows with their block: those of one length and kind, in as many parts as keep each within about `size` rows."""
    parts = rows.groupBy("dims", "kind").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = rows.join(parts, ["dims", "kind"]).withColumn("part", F.pmod(F.xxhash64(F.lit(prefix), "vec_id"), "parts").cast("int"))
    # New names for all columns: queries and rows come from one table.
    return dealt.select(F.col("vec_id").alias("vec_id"), F.col("x").alias("x"), *[F.col(c).alias(f"{prefix}_{c}") for c in _BLOCK])


def _met(left: DataFrame, right: DataFrame, keys: list[str], do: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.select(left.columns).groupBy(keys).cogroup(right.select(right.columns).groupBy(keys)).applyInArrow(do, schema)


def _summary(prefix: str) -> Callable[[pa.Table], pa.Table]:
    """Of a block: least and largest mean and largest deviation by segment, and the least score to beat."""

    def run(table: pa.Table) -> pa.Table:
        x = _floats(table.column("x"), table.num_rows)
        mean, deviation = segment_stats(x, min(BLOCK_SEGMENTS, x.shape[1]))
        beat = float(np.min(table.column("beat").to_numpy())) if prefix == "q" else 0.0
        held = {f"{prefix}_{c}": table.column(f"{prefix}_{c}")[:1] for c in _BLOCK}
        stats = {"low": mean.min(0), "high": mean.max(0), "deviation": deviation.max(0)}
        norm = float(np.sqrt((x * x).sum(1).max()))
        return pa.table(held | {k: pa.array([v.tolist()], pa.list_(pa.float64())) for k, v in stats.items()} | {"norm": [norm], "beat": [beat]})

    return run


def _near_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
    """Pairs of blocks of queries and of rows of one length whose statistics allow a score that is worth a look."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if a.num_rows and b.num_rows:
        get = lambda t, c: _floats(t.column(c), t.num_rows)
        low, high, deviation = (get(b, c) for c in ("low", "high", "deviation"))
        x_norm = b.column("norm").to_numpy()
        q_norm, beat = a.column("norm").to_numpy(), a.column("beat").to_numpy()
        q_low, q_high, q_deviation = (get(a, c) for c in ("low", "high", "deviation"))
        for i in range(a.num_rows):
            corners = [q_low[i] * low, q_low[i] * high, q_high[i] * low, q_high[i] * high]
            bound = np.max(corners, axis=0).sum(1) + deviation @ q_deviation[i]
            j = np.flatnonzero(bound >= beat[i] - q_norm[i] * x_norm * 1e-9 - 1e-6)
            out.append((np.full(len(j), i), j))
    i, j = (np.concatenate([o[m] for o in out]) if out else np.zeros(0, np.int64) for m in range(2))
    columns = {f"q_{c}": a.column(f"q_{c}").take(pa.array(i)) for c in _BLOCK} | {f"x_{c}": b.column(f"x_{c}").take(pa.array(j)) for c in _BLOCK}
    return pa.table(columns)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows with the highest inner product of floor(scale * component), for every row whose id is divisible by `every`, ties to the smaller id.

    The query's own id is no candidate. Null ids, and vectors that are null, empty, or hold null or non-finite
    components, take no part; vectors meet only those of their length; of rows that repeat an id the shortest,
    then the first by its components, counts. Other columns are ignored, whatever their names. Blocks of
    candidates go to the blocks of queries that may find something there; nothing but the pairs of blocks,
    while they are few, is broadcast."""
    rows = checkpointed(_prepared(vectors, scale, vec_id, vector))
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    bits = min(KIND_SEGMENTS, max(0, (n.rows // ROW_BLOCK).bit_length() - 1))
    rows = rows.withColumn("kind", F.shiftright("kind", KIND_SEGMENTS - bits))
    queries = rows.where(F.col("vec_id") % every == 0)
    left, right = _dealt(queries, QUERY_BLOCK, "q"), _dealt(rows, ROW_BLOCK, "x")
    keys = [f"{p}_{c}" for p in "qx" for c in _BLOCK]

    def first_scores(a: pa.Table, b: pa.Table) -> pa.Table:
        """The k-th best score of each query in one block of its kind; minus infinity where it has fewer."""
        (q_ids, q, _), (x_ids, x, _) = _sorted(a), _sorted(b)
        i, _, score = block_topk(q_ids, q, np.full(len(q_ids), -np.inf), x_ids, x, k)
        counts = np.bincount(i, minlength=len(q_ids)) if len(i) else np.zeros(len(q_ids), int)
        worst = np.full(len(q_ids), np.inf)
        np.minimum.at(worst, i, score.astype(np.float64))
        return pa.table({"vec_id": pa.array(q_ids, pa.int64()), "beat": np.where(counts >= k, worst, -np.inf)})

    # Every block of queries meets the first block of rows of its kind, of which there is one for each query.
    own = left.select("q_dims", "q_kind", "q_part").distinct().select(*[F.col(f"q_{c}").alias(c) for c in _BLOCK])
    seeds = right.where("x_part = 0").join(own.select(F.col("dims").alias("x_dims"), F.col("kind").alias("x_kind"), F.col("part").alias("q_part")), ["x_dims", "x_kind"])
    seeds = seeds.select(F.col("x_dims").alias("q_dims"), F.col("x_kind").alias("q_kind"), "q_part", "vec_id", "x")
    beat = _met(left, seeds, ["q_dims", "q_kind", "q_part"], first_scores, "vec_id LONG, beat DOUBLE")
    left = checkpointed(left.join(beat, "vec_id"))

    kinds = "dims INT, {0}_kind INT, {0}_part INT, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>, deviation ARRAY<DOUBLE>, norm DOUBLE, beat DOUBLE"
    stats = [df.groupBy([f"{p}_{c}" for c in _BLOCK]).applyInArrow(_summary(p), f"{p}_" + kinds.format(p)) for df, p in ((left, "q"), (right, "x"))]
    groups = [-(-(held // size + (1 << bits)) // META_BLOCK) for held, size in ((n.queries, QUERY_BLOCK), (n.rows, ROW_BLOCK))]  # so many blocks there are about
    hashed = lambda p, n: F.pmod(F.xxhash64(f"{p}_kind", f"{p}_part"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = stats[0].select("*", F.col("q_dims").alias("dims"), hashed("q", groups[0]).alias("g"), all_of(groups[1]).alias("h"))
    b = stats[1].select("*", F.col("x_dims").alias("dims"), hashed("x", groups[1]).alias("h"), all_of(groups[0]).alias("g"))
    near = checkpointed(_met(a, b, ["dims", "g", "h"], _near_blocks, ", ".join(f"{c} INT" for c in keys)))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        (q_ids, q, beat), (x_ids, x, _) = _sorted(a), _sorted(b)
        i, j, score = block_topk(q_ids, q, beat, x_ids, x, k)
        return pa.table({"query_id": pa.array(q_ids[i], pa.int64()), "vec_id": pa.array(x_ids[j], pa.int64()), "score": pa.array(score, pa.int64())})

    asked = left.join(near, [f"q_{c}" for c in _BLOCK]).select(*keys, "vec_id", "x", "beat")
    held = right.join(near, [f"x_{c}" for c in _BLOCK]).select(*keys, "vec_id", "x")
    found = _met(asked, held, keys, search, "query_id LONG, vec_id LONG, score LONG")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The search by brute force, for DuckDB.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
