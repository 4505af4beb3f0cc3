"""Near-duplicate documents by ProbMinHash.

A document is a weighted set of shingles (five words; weight count ** EXPONENT). Every shingle sends arrivals of
a Poisson process of its weight's rate to random registers; a register keeps the shingle that arrives first,
and a shingle stops once its next arrival is later than the document's latest register. Two documents agree
in a register with the probability Jaccard similarity of their weights.

Signatures are cut into bands; documents that share a band are candidates. Links are verified with the exact
Jaccard similarity of the shingle sets. What is wanted is classes (connected documents), so not all pairs of
a bucket are formed: its documents are compared with its smallest and its largest one. Every class then tries
its most promising pair, a few times, and all that are left. Where a bucket then still holds several
classes, all its pairs across classes are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import scratch, written

WORDS, SIMILARITY = 5, 0.8
REGISTERS, BANDS = 64, 16
#: Weights stay near 1, as links are verified by the sets: repeated shingles would else draw together documents that share little else.
EXPONENT = 1 / 16
#: Registers (their low bytes) that must agree before a pair is verified, by default: a pair at the limit falls short of that three times in a
#: hundred thousand. With 0 every pair that shares a bucket is verified.
LEAST_AGREEMENT = 38
#: Rows that may be broadcast; larger tables are joined by shuffle.
SMALL = 200_000
#: Rows of a bucket that are compared in one task.
BLOCK = 4096
CACHE_WORDS = 150_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of a text's shingles: runs of WORDS words, in lower case, cut at white space; a shorter text is one shingle, one without words none."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.factors = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)

    def words(self, text: str) -> list[str]:
        return text.lower().split()

    def shingles(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - WORDS + 1
        if n < 1:
            return _mix((h * self.factors[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))) if len(h) else h
        out = np.zeros(n, np.uint64)
        for i in range(WORDS):
            out += _mix(h[i : i + n] * self.factors[i])
        return _mix(out)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of REGISTERS shingles for each (distinct shingles, weights); rows of empty sets are zeros."""
    sizes = np.array([len(s) for s, _ in sets], np.int64)
    first = np.full(len(sets) * REGISTERS, np.inf)
    holds = np.zeros(len(sets) * REGISTERS, np.uint64)
    if not sizes.sum():
        return holds.reshape(-1, REGISTERS)
    item = np.concatenate([s for s, _ in sets])
    mean = 1.0 / np.concatenate([w for _, w in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    time = np.zeros(len(item))
    step = 0
    while len(item):
        step = (step + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        r = _mix(item + np.uint64(step))
        time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 1) * 2.0**-52) * mean
        place = doc * REGISTERS + (_mix(r + np.uint64(1)) % np.uint64(REGISTERS)).astype(np.int64)
        better = np.flatnonzero(time < first[place])
        np.minimum.at(first, place[better], time[better])
        won = better[time[better] == first[place[better]]]
        holds[place[won]] = item[won]
        latest = first.reshape(-1, REGISTERS).max(axis=1)
        going = time < latest[doc]
        item, mean, doc, time = item[going], mean[going], doc[going], time[going]
    return holds.reshape(-1, REGISTERS)


def document_key(doc_id: str, text: str) -> Column:
    """The id, or for a null one a negative number made of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), -F.shiftrightunsigned(F.xxhash64(F.col(text)), 2) - F.lit(2**62))


_SIGNED = "key LONG, digest BINARY, bands ARRAY<LONG>, low BINARY"


def sign(docs: DataFrame) -> DataFrame:
    """key, digest of the words in order, band hashes and the registers' low bytes, of rows of key and text. A text without words has no bands."""

    def rows(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler()
        seeds = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        factors = _mix(np.arange(100, 100 + REGISTERS // BANDS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                digests, sets = [], []
                for text in part.column(1).to_pylist():
                    words = shingler.words(text or "")
                    digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    shingles, counts = np.unique(shingler.shingles(words), return_counts=True)
                    sets.append((shingles, counts**EXPONENT))
                sig = signatures(sets)
                bands = _mix((_mix(sig).reshape(len(sets), BANDS, -1) * factors).sum(axis=2, dtype=np.uint64) + seeds).view(np.int64)
                low = _mix(sig).astype(np.uint8)
                for i, key in enumerate(part.column(0).to_pylist()):
                    has = len(sets[i][0]) > 0
                    yield (key, digests[i], bands[i].tolist() if has else [], low[i].tobytes() if has else None), 300

    return map_rows(docs.select("key", "text"), rows, _SIGNED)


def shingle_sets(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, and the text's sorted distinct shingles as 64-bit numbers."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(columns).schema.fields) + ", shingles BINARY"

    def rows(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler()
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = np.unique(shingler.shingles(shingler.words(values[-1] or ""))).tobytes()
                yield (*values[:-1], data), len(data) + 64

    return map_rows(docs.select(*columns, "text"), rows, schema)


def _similar(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    merged = np.sort(np.concatenate([p, q]), kind="stable")
    both = int((merged[1:] == merged[:-1]).sum())
    return both >= similarity * (len(p) + len(q) - both)


def linked(pairs: DataFrame, similarity: float) -> DataFrame:
    """The a and b of rows whose shingle sets x and y have at least that Jaccard similarity."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity):
                    yield (a, b), 16

    return map_rows(pairs.select("a", "b", "x", "y"), rows, "a LONG, b LONG")


def _small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        keys = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([root(k) for k in keys], pa.int64())], ["key", "class"])


def components(edges: DataFrame, one_task: int = SMALL) -> DataFrame:
    """key and class (the smallest key) of the nodes of a graph.

    Up to one_task edges are joined in one task. Of more, smallest labels spread over edges, then labels are
    replaced by their own labels, until none changes."""
    edges = edges.select("a", "b")
    if edges.limit(one_task + 1).count() <= one_task:
        return written(edges.repartition(1).mapInArrow(_union_find, "key LONG, class LONG"), "components")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    known = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "labels")
    while True:
        near = both.join(known.select(F.col("key").alias("b"), "class"), "b").groupBy(F.col("a").alias("key")).agg(F.min("class").alias("low"))
        spread = written(known.join(near, "key").select("key", F.col("class").alias("old"), F.least("class", "low").alias("class")), "spread")
        jump = spread.select(F.col("key").alias("class"), F.col("class").alias("next"))
        new = written(spread.join(jump, "class", "left").select("key", F.least(F.coalesce("next", "class"), "class").alias("class"), "old"), "labels")
        known = new.select("key", "class")
        if new.where("class <> old").isEmpty():
            return known


def _agreeing(pairs: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """The pairs of keys (a, b) that agree in enough registers, with their agreement."""
    low = [distinct.select(F.col("key").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in batch.columns[2:])
            agree = (x == y).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(agree)], ["a", "b", "agree"]).filter(pa.array(agree >= least))

    return pairs.join(low[0], "a").join(low[1], "b").select("a", "b", "low_a", "low_b").mapInArrow(run, "a LONG, b LONG, agree LONG")


_FOUND = {"best": "a LONG, b LONG, agree LONG", "keys": "band LONG, key LONG", "links": "a LONG, b LONG"}


def _across(rows: DataFrame, signed: DataFrame, what: str, least: int, similarity: float = SIMILARITY) -> DataFrame:
    """Looks at pairs of keys of different classes that share a bucket and agree in enough registers, each in the first bucket that they share. rows: band, key, class; signed: key, low, bands, and shingles for "links".

    "best": of a row's pairs with one class in a block, that of the most agreement; "keys": the keys of all
    pairs, by bucket; "links": the pairs that are similar by their shingle sets, one for a row and a class.
    A bucket's largest class isn't compared with itself: the rows of its other classes, the probes, go to each
    block of the bucket's rows. A task holds one block and all probes of its bucket: where a bucket has many
    classes left, that is most of the bucket."""
    sizes = rows.groupBy("band", "class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("m")).where("classes > 1")
    mixed = mixed.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.col("m.class").alias("main"))
    held = rows.join(mixed, "band").join(signed, "key")
    columns = ["key", "class", "low", "bands", *["shingles"] * (what == "links")]
    own = held.select("band", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("probe"), *columns)
    probe = held.where(F.col("class") != F.col("main")).select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"), *columns)

    def compare(table: pa.Table) -> pa.Table:
        key, class_ = table.column("key").to_numpy(), table.column("class").to_numpy()
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()] if what == "links" else []
        here = table.column("band")[0].as_py()
        probes = table.column("probe").to_numpy(zero_copy_only=False)
        r, pairs, keys = np.flatnonzero(~probes), [], set()
        for i in np.flatnonzero(probes).tolist():
            agree = (low[r] == low[i]).sum(axis=1)
            got = np.flatnonzero((agree >= least) & (class_[r] != class_[i]))
            got = got[bands[i][(bands[r[got]] == bands[i]).argmax(axis=1)] == here]
            got = got[np.lexsort((key[r[got]], -agree[got], class_[r[got]]))]
            if what == "best" and len(got):
                at = class_[r[got]]
                got = got[np.append(True, at[1:] != at[:-1])]
            elif what == "keys" and len(got):
                keys.update([int(key[i]), *key[r[got]].tolist()])
            elif what == "links":
                linked_to, kept = None, []
                for j in got.tolist():
                    if class_[r[j]] != linked_to and _similar(sets[i], sets[r[j]], similarity):
                        linked_to = class_[r[j]]
                        kept.append(j)
                got = np.array(kept, np.int64)
            pairs += [(int(key[i]), int(key[r[j]]), int(agree[j])) for j in got.tolist()] if what != "keys" else []
        if what == "keys":
            return pa.table({"band": pa.array([here] * len(keys), pa.int64()), "key": pa.array(sorted(keys), pa.int64())})
        columns = {"a": [min(p[:2]) for p in pairs], "b": [max(p[:2]) for p in pairs], "agree": [p[2] for p in pairs]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items() if k in _FOUND[what]})

    return own.unionByName(probe).groupBy("band", "block").applyInArrow(compare, _FOUND[what]).distinct()


def _labelled(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose keys are of different classes, with these (ca, cb); a key that known lacks is its own class."""
    for side in "ab":
        pairs = pairs.join(known.select(F.col("key").alias(side), F.col("class").alias(f"c{side}")), side, "left")
    pairs = pairs.select("a", "b", "agree", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return written(pairs.where("ca <> cb"), "pairs")


def _best(pairs: DataFrame) -> DataFrame:
    """Of the pairs that leave a class, the one of most agreement, for every class."""
    top = F.max(F.struct("agree", "a", "b")).alias("m")
    ends = pairs.select("a", "b", "agree", F.explode(F.array("ca", "cb")).alias("class"))
    return ends.groupBy("class").agg(top).select("m.a", "m.b").distinct()


class _Links:
    """Verifies pairs, and keeps the classes that the links found so far give."""

    def __init__(self, keyed: DataFrame, similarity: float):
        self.keyed, self.similarity, self.sets, self.known = keyed, similarity, None, None

    def fetch(self, keys: DataFrame) -> None:
        """Shingle sets of keys that are not held yet, into a table in the shared folder."""
        if self.sets is not None:
            keys = keys.join(self.sets.select("key"), "key", "left_anti")
        keys = written(keys, "keys")
        if self.sets is not None and keys.isEmpty():
            return
        hint = F.broadcast if _small(keys) else lambda x: x
        new = written(shingle_sets(self.keyed.join(hint(keys), "key", "left_semi"), ["key"]), "shingles")
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def add(self, chosen: DataFrame, labelled: DataFrame) -> None:
        """Joins the classes (ca, cb of labelled) of the chosen pairs that are similar."""
        self.fetch(chosen.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        hint = F.broadcast if _small(chosen) else lambda x: x
        with_x = self.sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")).join(hint(chosen.select("a", "b")), "a")
        others = self.sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")).join(hint(chosen.select("b").distinct()), "b", "left_semi")
        found = linked(with_x.join(others, "b"), self.similarity).distinct()
        links = written(found.join(labelled.select("a", "b", "ca", "cb"), ["a", "b"]).select("ca", "cb"), "links")
        if not links.isEmpty():
            self.known = _relabel(self.known, components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))


#: Rounds in which every class tries its best pair, before all that are left are verified.
ROUNDS = 1


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_AGREEMENT) -> DataFrame:
    """key and class, one row per distinct key of the rows of docs: class is the smallest key of the documents that are linked, directly or over others.

    Equal word sequences are linked, so are all texts without words; null texts have no words. Rows that repeat
    an id are one document: their classes are joined. A null id's key is a negative number made of its text.
    A pair at the limit shares a band, and agrees in enough registers, with probability 0.9997, more similar
    ones more surely. least: the registers that must agree; with 0 no pair that shares a band goes unverified."""
    keyed = docs.select(document_key(doc_id, text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = written(sign(keyed), "signed")
    lead = signed.groupBy("digest").agg(F.min("key").alias("lead"))
    copies = written(signed.select("key", "digest").join(lead, "digest").select("key", "lead").distinct(), "copies")
    firsts = copies.where("key = lead").select("key")
    distinct = signed.join(firsts, "key", "left_semi").select("key", "bands", "low").where("low is not null")
    again = firsts.join(signed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi")
    if not again.isEmpty():  # repeated ids: one signature for each
        distinct = distinct.dropDuplicates(["key"])
    distinct = written(distinct, "distinct")
    buckets = distinct.select(F.explode("bands").alias("band"), "key")
    hubs = buckets.groupBy("band").agg(F.min("key").alias("low_hub"), F.max("key").alias("high_hub"), F.count("*").alias("n")).where("n > 1")
    shared = written(buckets.join(hubs, "band"), "shared")
    to_hubs = shared.select("key", F.explode(F.array("low_hub", "high_hub")).alias("hub")).where("key <> hub")
    edges = to_hubs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    pairs = written(_agreeing(edges, distinct, least), "pairs")

    links = _Links(keyed, similarity)
    links.known = copies.sparkSession.createDataFrame([], "key LONG, class LONG")
    links.fetch(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    for i in range(ROUNDS + 1):
        pairs = _labelled(pairs.select("a", "b", "agree"), links.known)
        if pairs.isEmpty():
            break
        chosen = written(_best(pairs), "chosen") if i < ROUNDS else pairs
        links.add(chosen, pairs)
        pairs = pairs.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
    # Pairs of buckets of up to three rows have all been to their hubs.
    large = shared.where("n > 3").select("band", "key")
    label = lambda: large.join(links.known, "key", "left").select("band", "key", F.coalesce("class", "key").alias("class"))
    if not large.isEmpty():
        pairs = _labelled(_across(label(), distinct, "best", least), links.known)
        if not pairs.isEmpty():
            links.add(pairs, pairs)
            # What is left is verified within blocks: two large classes may have very many pairs, and no link.
            rows = label()
            some = written(_across(rows, distinct, "keys", least), "across")
            if not some.isEmpty():
                links.fetch(some.select("key").distinct())
                found = _across(rows.join(some, ["band", "key"]), distinct.join(links.sets, "key"), "links", least, similarity).withColumn("agree", F.lit(0).cast("long"))
                pairs = _labelled(found, links.known)
                if not pairs.isEmpty():
                    links.known = _relabel(links.known, components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    named = copies.join(links.known.select(F.col("key").alias("lead"), "class"), "lead", "left").select("key", F.coalesce("class", "lead").alias("class"))
    torn = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    if torn.isEmpty():
        return named
    joined = components(named.join(torn, "key").select(F.col("key").alias("a"), F.col("class").alias("b")))
    return _relabel(named, joined).groupBy("key").agg(F.min("class").alias("class"))


def _relabel(known: DataFrame, merged: DataFrame) -> DataFrame:
    """known, with classes (and classes that had no row of their own) replaced as merged says."""
    new = merged.select(F.col("key").alias("class"), F.col("class").alias("next"))
    moved = known.join(new, "class", "left").select("key", F.coalesce("next", "class").alias("class"))
    fresh = merged.join(known.select("key"), "key", "left_anti").where("key <> class").select("key", "class")
    return written(moved.unionByName(fresh), "classes")


def _found(docs: DataFrame, similarity: float, least: int) -> DataFrame:
    """classes(), as a table; the tables on the way to it are deleted."""
    with scratch(docs.sparkSession):
        found = written(classes(docs, similarity, least=least), "classes", outlive=True)
    return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_AGREEMENT) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class; see classes()), class_size (distinct keys) and is_first (the id is the class's)."""
    found = _found(docs, similarity, least)
    sizes = found.groupBy("class").agg(F.count("*").alias("class_size"))
    keyed = docs.select("doc_id", document_key("doc_id", "text").alias("key"))
    named = keyed.join(found, "key").join(sizes, "class")
    return named.select("doc_id", F.col("class").alias("class_id"), "class_size", (F.col("key") == F.col("class")).alias("is_first"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_AGREEMENT) -> DataFrame:
    """One row of each class, whole and with all its columns as they were: that of the smallest id; of rows that repeat this id, the one whose text sorts first.

    Of all texts without words (null, empty, blank) one row stays. Input columns may have any name."""
    found = _found(docs, similarity, least).where("key = class").select("key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # The rows stand in a struct, so that no name of theirs meets the key's.
    keyed = docs.select(document_key("doc_id", "text").alias("key"), F.struct(*columns).alias("row"))
    kept = keyed.join(found.hint("merge"), "key", "left_semi")  # the classes grow with the input: one plan at every size
    again = docs.select(document_key("doc_id", "text").alias("key")).join(found, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return kept.select("row.*")
    first = F.min_by("row", F.struct(F.col("row").getField("text"), F.xxhash64("row"))).alias("row")
    one = kept.join(again, "key", "left_semi").groupBy("key").agg(first).select("row.*")
    return kept.join(again, "key", "left_anti").select("row.*").unionByName(one)
