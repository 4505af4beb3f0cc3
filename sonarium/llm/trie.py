"""A trie of the turns that conversations begin with alike, by partition refinement.

All conversations start in one class. Each round takes some more turns of those that are still active, and each turn splits every
class by what is said; a class goes by a digest of its parent class and the turn, so that splitting is grouping. A conversation
that is alone in its class is retired: the rest of it is a chain of nodes without branches, made from its length alone. Rounds take
twice as many turns each time, so there are about as many as the longest shared beginning has bits.

Each node is owned by its smallest conversation, which then owns all nodes below on its own path. What is summed over subtrees is
therefore folded back from owners: along an owner's nodes by a running sum, and from the first of them to the classes above by one grouping.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import partitions, scratch, written

#: Turns of the first round.
FIRST_TURNS = 4
#: Conversation ids that are written out together: those that agree but for this many low bits.
ID_BITS = 12
#: The query's conversations borrow from the one whose id is the next multiple of this below, this many turns less one at most.
FAMILY, HEADS = 5, 9

_ROOT = b""


def head_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _turn_key(role: Column, text: Column) -> Column:
    """16 bytes for what is said; the role's length keeps role and text apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, 16)


def sequences(rows: DataFrame, family: int = 1, head: Callable[[int], int] | None = None) -> DataFrame:
    """conv_id, length, classes and sizes: for each conversation the class after each turn, and the bytes of each turn's text.

    With head, conversation c has the first head(c) turns of conversation c - c % family (all if fewer, none if there is no such
    one) in place of its own first head(c). Turns are ordered by turn (null first), rows of one turn by a digest of what
    they say. A null role or text is empty. Null conv_ids belong to no conversation; rows alike are turns of their own. A conversation
    is read in order by one task, without texts, which holds 24 bytes for a turn."""

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        lead: tuple[int, list] = (-1, [])  # the first turns of the family's first conversation
        for conv_id, turns in _conversations(batches):
            first = conv_id - conv_id % family
            if head is None or conv_id == first:
                said = turns
                lead = (first, turns[: HEADS - 1])
            else:
                n = head(conv_id)
                said = (lead[1][:n] if lead[0] == first else []) + turns[n:]
            at, classes = _ROOT, []
            for key, _ in said:
                at = hashlib.sha256(at + key).digest()[:16]
                classes.append(at)
            yield (conv_id, len(said), classes, [size for _, size in said]), 64 + 48 * len(said)

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    held = rows.where(conv.isNotNull()).select(
        conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), _turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("size")
    )
    held = held.repartition(partitions(rows.sparkSession), F.col("conv_id") - F.pmod("conv_id", F.lit(family)))
    held = held.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key").drop("turn")
    return map_rows(held, chains, "conv_id BIGINT, length BIGINT, classes ARRAY<BINARY>, sizes ARRAY<BIGINT>")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    held, turns = None, []
    for batch in batches:
        for conv_id, key, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if conv_id != held and turns:
                yield held, turns
                turns = []
            held = conv_id
            turns.append((key, size))
    if turns:
        yield held, turns


def _refined(convs: DataFrame, first_turns: int) -> DataFrame:
    """The nodes below the root that more than one conversation shares, and the first node of each that stands alone.

    class, depth, parent (its class), size, n, owner, longest (length of its conversations)."""
    rounds, active, low, step = [], convs, 0, first_turns
    while True:
        turns = F.posexplode(F.arrays_zip(F.slice("classes", low + 1, step).alias("class"), F.slice("sizes", low + 1, step).alias("size")))
        above = F.lit(_ROOT) if low == 0 else F.get("classes", F.lit(low - 1))
        held = active.select("conv_id", "length", above.alias("above"), F.slice("classes", low + 1, step).alias("path"), turns.alias("i", "turn"))
        parent = F.when(F.col("i") == 0, F.col("above")).otherwise(F.get("path", F.col("i") - 1))
        split = held.select("conv_id", "length", (F.col("i") + low + 1).cast("long").alias("depth"), F.col("turn")["class"].alias("class"), parent.alias("parent"), F.col("turn")["size"].alias("size"))
        one = lambda c: F.min(c).alias(c)  # noqa: E731  the same in all rows of a class
        nodes = split.groupBy("class").agg(one("depth"), one("parent"), one("size"), F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.max("length").alias("longest"))
        nodes = written(nodes, "trie-nodes")
        shared, alone = nodes.where("n > 1"), nodes.where("n = 1")
        first = Window.partitionBy("owner").orderBy("depth")
        rounds += [shared, alone.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")]
        low, step = low + step, step * 2
        left = active.where(F.col("length") > low).join(alone.select(F.col("owner").alias("conv_id")).distinct(), "conv_id", "left_anti")
        active = written(left, "trie-active")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def _end_digests(ends: DataFrame) -> DataFrame:
    """class, ends_sha256: of the ids in each class, ascending and comma-joined; a task holds some thousands of them at a time."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        held, sha = None, None
        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != held or sha is None:
                    if sha is not None:
                        yield (held, sha.hexdigest()), 96
                    held, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if sha is not None:
            yield (held, sha.hexdigest()), 96

    some = ends.groupBy("class", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    some = some.repartition(partitions(ends.sparkSession), "class").sortWithinPartitions("class", "block").select("class", "ids")
    return map_rows(some, digests, "class BINARY, ends_sha256 STRING")


def prefix_trie(convs: DataFrame, first_turns: int = FIRST_TURNS) -> DataFrame:
    """One row per node of the trie over sequences(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of first turns, named by the smallest conversation that begins with it and its depth, and so its last
    turn is that conversation's turn of that number. The root has depth 0 and no parent. An empty table gives no node; a conversation
    without turns ends at the root; equal conversations end at the same node."""
    spark = convs.sparkSession
    with scratch(spark):
        convs = written(convs, "trie-convs")
        root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.max("length").alias("longest")).where("n > 0")
        none_yet = F.lit(0).cast("long")
        root = root.select(F.lit(_ROOT).alias("class"), none_yet.alias("depth"), F.lit(None).cast("binary").alias("parent"), none_yet.alias("size"), "n", "owner", "longest")
        nodes = root.unionByName(_refined(convs, first_turns))
        alone = (F.col("n") == 1) & (F.col("depth") > 0)
        saving = (F.col("n") - 1) * F.col("size")
        leaf = (alone | (F.col("longest") == F.col("depth"))).cast("long")
        path, down = Window.partitionBy("owner"), Window.partitionBy("owner").orderBy(F.col("depth").desc())
        owned = nodes.select("*", alone.alias("alone"), F.sum(saving).over(down).alias("below"), F.sum(leaf).over(path).alias("leaves"), F.min("depth").over(path).alias("top"))
        owned = written(owned, "trie-owned")

        chains = owned.groupBy("owner").agg(F.min("depth").alias("top"), F.max("below").alias("saved"), F.max("leaves").alias("leaves")).where("top > 0")
        path_above = F.concat(F.array(F.lit(_ROOT)), F.slice("classes", F.lit(1), (F.col("top") - 1).cast("int")))
        above = chains.join(convs, F.col("owner") == F.col("conv_id")).select("saved", "leaves", F.explode(path_above).alias("class"))
        folded = above.groupBy("class").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        children = owned.where("parent IS NOT NULL").groupBy(F.col("parent").alias("class")).agg(F.count("*").alias("children"))
        retired = owned.where("alone").select(F.col("owner").alias("conv_id"))
        ends = convs.join(retired, "conv_id", "left_anti").select("conv_id", F.when(F.col("length") == 0, F.lit(_ROOT)).otherwise(F.element_at("classes", -1)).alias("class"))
        facts = [folded, children, _end_digests(ends)]
        facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts).groupBy("class").agg(*[F.max(c).alias(c) for c in ("saved", "leaves", "children", "ends_sha256")])

        firsts = owned.where((F.col("depth") == F.col("top")) & (F.col("depth") > 1)).select("owner", F.col("parent").alias("class"))
        parents = firsts.join(owned.where("NOT alone").select("class", F.col("owner").alias("parent_owner")), "class").select("owner", "parent_owner")
        least = root.select(F.col("owner").alias("least")).first()
        least = F.lit(least[0] if least else None).cast("long")
        none = F.sha2(F.lit("").cast("binary"), 256)
        owned = owned.join(parents, "owner", "left")
        parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == 1, least).when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("parent_owner"))
        owned = owned.withColumn("parent_conv_id", parent)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        shared = owned.where("NOT alone").withColumnsRenamed({"leaves": "own_leaves"}).join(facts, "class", "left")
        shared = shared.select(
            F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), zero("children").alias("n_children"),
            (F.col("own_leaves") + zero("leaves")).alias("n_leaves"), (F.col("below") + zero("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
        tails = owned.where("alone").select("owner", F.col("depth").alias("from"), "longest", "parent_conv_id", F.explode(F.sequence("depth", "longest")).alias("depth"))
        one, last = F.lit(1).cast("long"), F.col("depth") == F.col("longest")
        tails = tails.select(
            F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent_conv_id")).otherwise(F.col("owner")).alias("parent_conv_id"), one.alias("n_convs"),
            (~last).cast("long").alias("n_children"), one.alias("n_leaves"), (one * 0).alias("saved_tokens"), F.when(last, F.sha2(F.col("owner").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
        )
        return written(shared.unionByName(tails), "trie", outlive=True)


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations that are rebuilt upon the beginnings of others, see sequences()."""
    return prefix_trie(sequences(rows, FAMILY, head_turns))


#: crc32 by its table of remainders; nodes by digests of the paths to them; sums over subtrees by the paths of their owners.
TRIE_SQL = r"""
WITH
crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda h, b: CASE WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END) AS v
    FROM range(256) r(i))),
turns AS (
  SELECT conv_id, octet_length(encode(said)) AS size, key,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos
  FROM (
    SELECT conv_id, turn, coalesce(text, '') AS said, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
    FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (
  SELECT conv_id AS c, conv_id - ((conv_id % 5) + 5) % 5 AS first, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda h, b: xor(h // 256, t[1 + (xor(h, b) & 255)])), 4294967295) % 9 AS head
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
built AS (
  SELECT c, list(key ORDER BY own, pos) AS keys, list(size ORDER BY own, pos) AS sizes FROM (
    SELECT c, 0 AS own, pos, key, size FROM conv JOIN turns ON conv_id = first AND pos <= head
    UNION ALL SELECT c, 1, pos, key, size FROM conv JOIN turns ON conv_id = c AND pos > head)
  GROUP BY c),
every AS (SELECT c, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM conv LEFT JOIN built USING (c)),
path AS (
  SELECT c, d, len(keys) AS n, sha256(array_to_string(keys[1:d], '')) AS p,
    CASE WHEN d > 0 THEN sha256(array_to_string(keys[1 : d - 1], '')) END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(generate_series(0, len(keys))) AS d FROM every)),
node AS (
  SELECT p, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n, (max(n) = any_value(d))::BIGINT AS leaf, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM path GROUP BY p),
folded AS (
  SELECT path.p, sum(leaf) AS leaves, sum(saved) AS saved FROM node JOIN path ON path.c = node.c AND path.d <= node.d GROUP BY path.p),
kids AS (SELECT up AS p, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up)
SELECT node.c AS conv_id, node.d AS depth, above.c AS parent_conv_id, node.n AS n_convs, coalesce(kids, 0) AS n_children, leaves::BIGINT AS n_leaves,
  folded.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN folded USING (p) LEFT JOIN kids USING (p) LEFT JOIN node above ON above.p = node.up
"""
