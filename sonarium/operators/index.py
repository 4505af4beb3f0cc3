"""A term index that lies in storage: postings bucketed by term, in segments that are never changed, with tombstones and compaction.

An index is a folder of the shared storage. Its postings (id, term, segment) are one table, bucketed and sorted by term; a batch
of changes appends a segment to it, and a tombstone (id, segment) for each document that it replaces or deletes. A posting counts
unless its document has a tombstone of a later segment. A commit, written last and once only, names the segments that count, so a
batch that failed halfway is never seen, and whoever holds an index goes on reading what it was. A search for some terms
reads their buckets alone; the plan stays the same however many batches there were. Compaction writes what counts into
a table of the next version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.functions import fingerprint as fp
from sonarium.operators.state import numbered
from sonarium.sources.tables import delete, shared_folder

#: The attribute that holds the newest indexed id.
NEWEST = "max_document_id"
#: Buckets of an index unless told otherwise; terms that a search may name in its scan (a request has no more), beyond which it joins all buckets.
BUCKETS, MOST_NAMED = 32, 2400
#: Documents whose postings go to one file, about; a task has them in memory.
PER_FILE = 10_000
#: How many files a task that writes may hold open.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


class Conflict(RuntimeError):
    """Another writer has committed to the index meanwhile."""


def masked(hashes: str = "hashes"):
    return F.array_distinct(F.transform(fp.to_unsigned(F.col(hashes)), lambda x: x.bitwiseAND(F.lit(fp.TERM_MASK))))


def term_index(corpus: DataFrame, key: str = "id", hashes: str = "hashes", every_term: bool = False, lists: bool = False) -> DataFrame:
    """key and term: the query terms of each fingerprint, or all its masked hashes; or with lists key and terms, a row for each fingerprint."""
    terms = masked(hashes) if every_term else fp.extract_query(F.col(hashes))
    return corpus.select(key, terms.alias("terms") if lists else F.explode(terms).alias("term"))


#: Postings that are packed together, at most.
PACKED = 1 << 20


def _small(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, all lowest bytes first: the higher ones hardly differ."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _large(data: bytes, n: int) -> np.ndarray:
    held = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(held.reshape(8, n).T).view(np.int64).reshape(-1)


def packed(rows: DataFrame) -> DataFrame:
    """part, n, keys and terms: postings of three columns (part, key, term) as a row for many of one part, some bytes for each posting, where a row of the shuffle would take
    three times as much. part and term may be lists, of the same length, which spares a row for each posting on the way here. A null key or term names nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, keys, terms in gathered(batches):
            order = np.argsort(terms, kind="stable")
            order = order[np.argsort(parts[order].astype(np.uint16 if parts.max() < 1 << 16 else np.int64), kind="stable")]
            parts, keys, terms = parts[order], keys[order], terms[order]
            edges = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts)).tolist()
            some = list(zip(edges[:-1], edges[1:], strict=True))
            columns = [pa.array(parts[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32))]
            columns.append(pa.array([_small(keys[i:j]) for i, j in some], pa.binary()))
            columns.append(pa.array([_small(np.diff(terms[i:j], prepend=0)) for i, j in some], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "keys", "terms"])

    def flat(batch: pa.RecordBatch) -> list[np.ndarray]:
        parts, keys, terms = batch.columns
        if pa.types.is_list(terms.type):
            keys = pa.array(np.repeat(np.asarray(keys), np.asarray(pc.fill_null(pc.list_value_length(terms), 0))))
            parts, terms = parts.flatten(), terms.flatten()
        if terms.null_count:
            parts, keys, terms = (c.filter(terms.is_valid()) for c in (parts, keys, terms))
        return [np.asarray(c) for c in (parts, keys, terms)]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            held.append(flat(batch))
            n += len(held[-1][0])
            if n >= PACKED:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                for low in range(0, n - PACKED + 1, PACKED):
                    yield [x[low : low + PACKED] for x in every]
                held, n = [[x[n - n % PACKED :] for x in every]], n % PACKED
        if n:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    part, key, term = rows.columns
    as_list = "array<{}>" if isinstance(rows.schema[term].dataType, T.ArrayType) else "{}"
    kinds = ((part, as_list.format("int"), "part"), (key, "long", "key"), (term, as_list.format("long"), "term"))
    plain = rows.where(F.col(f"`{key}`").isNotNull()).select(*[F.col(f"`{c}`").cast(t).alias(a) for c, t, a in kinds])
    return plain.mapInArrow(pack, "part int, n int, keys binary, terms binary")


def unpacked(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The keys and terms of packed postings, of all rows that follow each other with the same values of some columns together, and these values first."""
    at, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in (*by, "n", "keys", "terms")], strict=True):
            if row[:-3] != at:
                if held:
                    yield (at, *_together(held))
                at, held = row[:-3], []
            held.append(row[-3:])
    if held:
        yield at, *_together(held)


def _together(held: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    edges = np.cumsum([0, *[n for n, _, _ in held]])
    keys, terms = (np.empty(edges[-1], np.int64) for _ in range(2))
    for i, (n, k, t) in enumerate(held):
        keys[edges[i] : edges[i + 1]] = _large(k, n)
        np.cumsum(_large(t, n), out=terms[edges[i] : edges[i + 1]])
    held.clear()
    return keys, terms


@dataclass(frozen=True)
class TermIndex:
    """An index as of one commit. named: its tables' name in the session; number: of the commit; version: of the tables; segments: those that count; deletes: whether any has tombstones; documents: at most so many."""

    spark: SparkSession
    folder: str
    named: str
    buckets: int
    number: int = 0
    version: int = 0
    segments: tuple[int, ...] = ()
    deletes: bool = False
    documents: int = 0
    held: tuple[tuple[str, int], ...] = ()

    # Storage

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.version}"

    def _table(self, name: str, columns: str, key: str) -> str:
        """The name of a table of this version, made known to the session where it isn't yet."""
        full = f"{self.named}_{name}_{self.version}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self._path(name)}'")
        return full

    def _postings(self) -> str:
        return self._table("terms", "id BIGINT, term BIGINT, segment INT", "term")

    def _tombstones(self) -> str:
        return self._table("dead", "id BIGINT, segment INT", "id")

    def _append(self, name: str, rows: DataFrame, key: str) -> None:
        """Writes rows whose tasks have one bucket each, and are sorted by the key within it; a writer would compare bucket and key of each pair of rows. One that may hold several files open asks for no order."""
        before = self.spark.conf.get(OPEN_FILES)
        self.spark.conf.set(OPEN_FILES, str(self.buckets))
        try:
            rows.write.format("parquet").bucketBy(self.buckets, key).mode("append").saveAsTable(name)
        finally:
            self.spark.conf.set(OPEN_FILES, before)

    def _files(self, documents: int) -> int:
        """A multiple of the buckets, dealt by the same hash: each task writes one file of one bucket, and a bucket has several files where there are many documents."""
        return self.buckets * max(1, -(-documents // (self.buckets * PER_FILE)))

    def _append_postings(self, rows: DataFrame, segment: int, documents: int) -> None:
        """Writes id and term, or id and terms, of so many documents. They travel packed, and a task sorts the terms of its file by themselves."""
        n = self._files(documents)
        of = lambda x: F.pmod(F.hash(x), F.lit(n))
        term = "terms" if "terms" in rows.columns else "term"
        part = F.transform(term, of) if term == "terms" else of(F.col(term))

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, ids, terms in unpacked(batches, []):
                order = np.argsort(terms, kind="stable")
                for low in range(0, len(order), 1 << 16):
                    some = order[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(terms[some])], ["id", "term"])

        dealt = packed(rows.select(part.alias("part"), "id", term)).repartitionById(n, "part")
        self._append(self._postings(), dealt.mapInArrow(sort, "id long, term long").withColumn("segment", F.lit(segment)), "term")

    def _append_tombstones(self, rows: DataFrame, segment: int, documents: int) -> None:
        rows = rows.select(F.col("id").cast("long").alias("id"), F.lit(segment).alias("segment"))
        self._append(self._tombstones(), rows.repartition(self._files(documents), "id").sortWithinPartitions("id"), "id")

    def _committed(self) -> TermIndex:
        """Writes the commit that this index is; Conflict if there is one of its number."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{self.number:09d}.json")
        files = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        body = {"buckets": self.buckets, "version": self.version, "segments": self.segments, "deletes": self.deletes, "documents": self.documents, "held": dict(self.held)}
        if files.exists(place):
            raise Conflict(f"commit {self.number} of {self.folder} is there")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if not files.rename(draft, place):
            raise Conflict(f"commit {self.number} of {self.folder} is there")
        return self

    # Reading

    @cached_property
    def attributes(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.held), "name STRING, value LONG")

    def attribute(self, name: str, default: int = 0) -> int:
        return dict(self.held).get(name, default)

    def postings(self, named: list[int] | None = None) -> DataFrame:
        """id, term and segment of the segments that count; with named terms, of these alone, from their buckets."""
        rows = self.spark.table(self._postings()).where(F.col("segment").isin(list(self.segments)) if self.segments else F.lit(False))
        return rows if named is None else rows.where(F.col("term").isin(named))

    def alive(self, rows: DataFrame) -> DataFrame:
        """Of rows with id and segment those whose document was not replaced or deleted later, without the segment."""
        if not self.deletes:
            return rows.drop("segment")
        dead = self.spark.table(self._tombstones()).where(F.col("segment").isin(list(self.segments))).groupBy("id").agg(F.max("segment").alias("gone_"))
        return rows.join(dead, "id", "left").where(F.col("gone_").isNull() | (F.col("segment") >= F.col("gone_"))).drop("gone_", "segment")

    @property
    def terms(self) -> DataFrame:
        """id and term of all documents."""
        return self.alive(self.postings()).select("id", "term")

    def holding(self, asked: DataFrame) -> DataFrame:
        """id and term of all documents that have one of the terms asked for (term). Up to MOST_NAMED terms are named in the scan, which then reads their buckets alone."""
        named = [r.term for r in asked.select("term").distinct().limit(MOST_NAMED + 1).collect()]
        return self.alive(self.postings(named if len(named) <= MOST_NAMED else None)).select("id", "term")

    def info(self) -> dict[str, int]:
        """Documents, terms, and all attributes."""
        n = self.terms.agg(F.count_distinct("id").alias("documents"), F.count("*").alias("terms")).first()
        return {"documents": n.documents, "terms": n.terms} | dict(self.held)

    # Writing

    def _next(self, added: DataFrame, gone: DataFrame | None, documents: int, attributes: dict[str, int] | None) -> TermIndex:
        segment = max(self.segments, default=0) + 1 + (uuid.uuid4().int % 1000)  # a failed batch's rows bear a number that never counts
        self._append_postings(added, segment, documents)
        if gone is not None:
            self._append_tombstones(gone, segment, documents)
        held = dict(self.held) | (attributes or {})
        return replace(self, number=self.number + 1, segments=(*self.segments, segment), deletes=self.deletes or gone is not None, documents=self.documents + documents, held=tuple(held.items()))._committed()

    def updated(self, changes: DataFrame, attributes: dict[str, int] | None = None) -> TermIndex:
        """The index after one batch of changes (id, hashes; null hashes delete), with attributes set in the same step. An inserted document replaces its terms."""
        changes = changes.select(F.col("id").cast("long").alias("id"), "hashes")
        return self._next(term_index(changes.where("hashes is not null"), every_term=True, lists=True), changes.select("id").distinct() if self.segments else None, changes.count(), attributes)

    def grown(self, corpus: DataFrame, most: int = 1000) -> TermIndex:
        """The index with the next documents (id, hashes) above the newest one it has, `most` of them, by their query terms."""
        rows = corpus.where(F.col("id") > self.attribute(NEWEST))
        if rows.count() > most:
            # Ids alone are put in order; a limit would bring all hashes to one task.
            last = numbered(rows.select("id"), ["id"]).where(F.col("n") <= most).agg(F.max("id")).first()[0]
            rows = rows.where(F.col("id") <= F.lit(last)) if last is not None else rows.where("false")
        newest, n = rows.agg(F.max("id"), F.count("*")).first()
        if newest is None:
            return self
        return self._next(term_index(rows, lists=True), None, n, {NEWEST: newest})

    def compacted(self) -> TermIndex:
        """The index with all that counts in one segment of new tables. The tables of the version before the last stay for their readers, older ones go."""
        after = replace(self, number=self.number + 1, version=self.version + 1, segments=(1,), deletes=False)
        after._append_postings(self.terms, 1, self.documents)
        after._committed()
        if self.version:
            old = replace(self, version=self.version - 1)
            for name in ("terms", "dead"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.named}_{name}_{old.version}")
                delete(self.spark, old._path(name))
        return after


def _named(folder: str) -> str:
    return "index_" + uuid.uuid5(uuid.NAMESPACE_URL, folder).hex[:12]


def new_index(spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS) -> TermIndex:
    """An index without documents, in a folder of its own."""
    folder = folder or shared_folder(spark, "index")
    return TermIndex(spark, folder, _named(folder), buckets)._committed()


def open_index(spark: SparkSession, folder: str) -> TermIndex:
    """The index as of its last commit; any session may open it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    last = max(x.getPath().getName() for x in files.listStatus(place) if x.getPath().getName().endswith(".json"))
    body = json.loads(spark.read.text(f"{folder}/commits/{last}", wholetext=True).first().value)
    return TermIndex(spark, folder, _named(folder), body["buckets"], int(last.split(".")[0]), body["version"], tuple(body["segments"]), body["deletes"], body["documents"], tuple(body["held"].items()))


def remove_index(index: TermIndex) -> None:
    """Deletes an index with all its versions."""
    for version in range(index.version + 1):
        for name in ("terms", "dead"):
            index.spark.sql(f"DROP TABLE IF EXISTS {index.named}_{name}_{version}")
    delete(index.spark, index.folder)
