"""Benchmark decontamination: an FM-index over the words of each shard of documents, searched backward for the phrases of test items.

A shard is some documents in a row of one input partition. Its text is the sequence of its words as numbers; a word that
no phrase has can be in no occurrence, so each stretch of such words, and each document's end, is one separator (0).
The index of a shard is the transform of that sequence in a wavelet matrix, with positions kept at every 32nd word and at
each stretch's first one. Nothing is shuffled: documents stay in the partition they were read in.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import written

WINDOW = 10
#: Words of a shard, 2 ** 20 at most. A longer document goes over several shards that overlap by a window less a word.
SHARD_WORDS = 1 << 19
#: Bytes of phrases that one pass over the documents looks for; more go in further passes.
PHRASE_BYTES = 32 << 20
#: Every so many words a position is kept; occurrences that are located at once.
SAMPLE, LOCATED = 32, 1 << 18

#: Bytes of words to themselves, A-Z to lower case, others to spaces.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_PHRASES = "phrase BINARY, item STRING"
_CARRIED = "n_words BIGINT, hits ARRAY<STRUCT<start: INT, length: INT>>, item_ids ARRAY<STRING>"
_RESULT = "doc_id BIGINT, n_words BIGINT, n_hit BIGINT, item_ids ARRAY<STRING>, spans ARRAY<STRUCT<start: INT, length: INT>>"


def split_words(raw: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_FOLD).split()


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All positions, by the symbols from there up to the first 0; equal ones by position. The last symbol must be 0.

    Sorted by as many symbols as fit into a word with the position, then by twice as many each time, only where suffixes tie."""
    n, symbols = len(symbols), symbols.astype(np.int64)
    low, width = n.bit_length(), max(1, int(symbols.max()).bit_length())
    mask, known = (1 << low) - 1, max(1, (63 - low) // width)
    key = symbols
    for m in range(1, known):
        key = (symbols << (width * m)) | np.where(symbols != 0, np.append(key[1:], 0), 0)
    ended = (key & ((1 << width) - 1)) == 0
    packed = np.sort(key << low | np.arange(n))
    order, rank = packed & mask, np.empty(n, np.int64)
    first = np.append(True, (packed[1:] >> low) != (packed[:-1] >> low))
    first |= ended[order]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.append(first[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        held = order[slots]
        packed = np.sort(rank[held] << (2 * low) | rank[held + known] << low | held)
        held = packed & mask
        order[slots] = held
        first = np.append(True, (packed[1:] >> low) != (packed[:-1] >> low))
        rank[held] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.append(first[1:], True))]
        known *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of the symbols per level; all queries go through a level together."""

    def __init__(self, symbols: np.ndarray):
        self.width = max(1, int(symbols.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        held = symbols
        for level in reversed(range(self.width)):
            bits = (held >> level & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(bits, dtype=np.int32)).astype(np.int32))
            held = np.concatenate([held[~bits], held[bits]])
            self.zeros.append(len(held) - int(self.ones[-1][-1]))
        self.start = self._down(np.arange(1 << self.width), np.zeros(1 << self.width, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where(symbols >> (self.width - 1 - i) & 1, zeros + up, at - up)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.start[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each stands before."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at]
            bit = ones[at + 1] - up
            symbols = symbols << 1 | bit
            at = np.where(bit, zeros + up, at - up)
        return symbols, at - self.start[symbols]


class FmIndex:
    """Count and locate over a sequence of symbols in which 0 ends a stretch; patterns hold no 0."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        before = symbols[order - 1].astype(np.int32)  # before the first one comes the last one, a 0
        self.matrix = WaveletMatrix(before)
        self.size = len(symbols)
        self.less = np.append(0, np.cumsum(np.bincount(symbols, minlength=1 << self.matrix.width)))
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.before_kept, self.positions = kept, np.cumsum(kept) - kept, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the first and the end of the suffixes that begin with it, by backward search."""
        possible = (patterns < 1 << self.matrix.width).all(1)
        low, high = np.zeros(len(patterns), np.int64), np.where(possible, self.size, 0)
        alive = np.flatnonzero(possible)
        for column in reversed(range(patterns.shape[1])):
            symbols = patterns[alive, column]
            base = self.less[symbols]
            low[alive] = base + self.matrix.rank(symbols, low[alive])
            high[alive] = base + self.matrix.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The positions of suffixes, by steps back to the nearest kept one; none lies beyond the stretch's first word."""
        found, steps, left = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(left):
            done = self.kept[at]
            found[left[done]] = self.positions[self.before_kept[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbols, rank = self.matrix.access(at)
            at = self.less[symbols] + rank
            steps += 1
        return found


class Phrases:
    """The phrases that one pass looks for, and the items that have them."""

    def __init__(self, rows: Iterable[tuple[bytes, str]]):
        held: dict[bytes, set[str]] = {}
        for phrase, item in rows:
            held.setdefault(bytes(phrase), set()).add(item)
        self.items = [tuple(x) for x in held.values()]
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, tuple[list[list[int]], list[int]]] = {}
        for at, phrase in enumerate(held):
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in phrase.split(b" ")]
            patterns, which = by_length.setdefault(len(words), ([], []))
            patterns.append(words)
            which.append(at)
        self.by_length = [(n, np.array(p, np.int64), np.array(w, np.int64)) for n, (p, w) in sorted(by_length.items())]
        self.longest = max(by_length, default=1)

    def occurrences(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Positions, phrases and their length, for all occurrences in a sequence of symbols."""
        index = FmIndex(symbols)
        for length, patterns, which in self.by_length:
            low, high = index.search(patterns)
            many = np.maximum(high - low, 0)
            ends = np.cumsum(many)
            for begin in range(0, int(ends[-1]), LOCATED):
                at = np.arange(begin, min(begin + LOCATED, int(ends[-1])))
                row = np.searchsorted(ends, at, side="right")
                yield index.locate(high[row] - (ends[row] - at)), which[row], length


class _Document:
    """A document on its way: its row, its words, and what has been found so far."""

    def __init__(self, row: dict, phrases: Phrases):
        self.row = row
        words = split_words(row["raw"] or b"")
        self.n = len(words)
        self.symbols = np.fromiter(map(phrases.numbers.get, words, repeat(0)), np.int32, self.n)
        self.hit: np.ndarray | None = None
        self.items: set[str] = set(row.get("item_ids") or ())
        for x in row.get("hits") or ():
            self.cover(x["start"], np.ones(x["length"], bool))
        self.pieces = 0

    def cover(self, start: int, hit: np.ndarray) -> None:
        if self.hit is None:
            self.hit = np.zeros(self.n, bool)
        self.hit[start : start + len(hit)] |= hit

    def word_spans(self) -> list[dict[str, int]]:
        if self.hit is None:
            return []
        edge = np.flatnonzero(np.diff(np.concatenate([[0], self.hit.view(np.int8), [0]])))
        return [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]

    def char_spans(self, spans: list[dict[str, int]]) -> list[dict[str, int]]:
        """The same spans in characters of the text, from a first word's begin to a last word's end."""
        if not spans:
            return []
        raw = np.frombuffer(self.row["raw"], np.uint8)
        inside = np.frombuffer(self.row["raw"].translate(_FOLD), np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        chars = np.append(0, np.cumsum(raw & 0xC0 != 0x80))
        begin, end = chars[edge[::2]], chars[edge[1::2]]
        return [{"start": int(begin[x["start"]]), "length": int(end[x["start"] + x["length"] - 1] - begin[x["start"]])} for x in spans]


def _shards(rows: Iterable[dict], phrases: Phrases, shard_words: int) -> Iterator[_Document]:
    """Documents in their order, searched shard by shard."""
    held: deque[_Document] = deque()
    pieces: list[tuple[_Document, int, np.ndarray]] = []
    size, held_bytes, overlap = 0, 0, phrases.longest - 1

    def search() -> None:
        """Builds the index of the pieces, and notes what occurs in each document."""
        if not pieces:
            return
        text = np.concatenate([x for _, _, s in pieces for x in (s, [0])]).astype(np.int64)
        starts = np.cumsum([0, *(len(s) + 1 for _, _, s in pieces)])
        kept = np.flatnonzero((text != 0) | np.append(True, text[:-1] != 0))  # a stretch of 0 is one 0
        change = np.zeros(len(text) + 1, np.int32)
        found = [np.zeros(0, np.int64)]
        for at, which, length in phrases.occurrences(text[kept]):
            at = kept[at]
            change += np.bincount(at, minlength=len(change)) - np.bincount(at + length, minlength=len(change))
            piece = np.searchsorted(starts, at, side="right") - 1
            found.append(np.unique(piece * len(phrases.items) + which))
        pairs = np.unique(np.concatenate(found))
        hit = np.cumsum(change) > 0
        for piece, which in zip(*(x.tolist() for x in np.divmod(pairs, len(phrases.items))), strict=True):
            pieces[piece][0].items.update(phrases.items[which])
        for piece in np.unique(pairs // len(phrases.items)).tolist():
            doc, begin, symbols = pieces[piece]
            doc.cover(begin, hit[starts[piece] : starts[piece] + len(symbols)])
        for doc, _, _ in pieces:
            doc.pieces -= 1
        pieces.clear()

    for row in rows:
        doc = _Document(row, phrases)
        held.append(doc)
        held_bytes += len(row["raw"] or b"")
        begin = 0
        while begin < doc.n:
            if shard_words - size <= overlap + 1:
                search()
                size = 0
            symbols = doc.symbols[begin : begin + shard_words - size - 1]
            size += len(symbols) + 1
            if symbols.any():
                pieces.append((doc, begin, symbols))
                doc.pieces += 1
            begin += len(symbols) - (overlap if begin + len(symbols) < doc.n else 0)
        if held_bytes > 16 * shard_words or len(held) >= 20_000:
            search()
            size = 0
        while held and not held[0].pieces:
            held_bytes -= len(held[0].row["raw"] or b"")
            yield held.popleft()
    search()
    yield from held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from batch.slice(i, 256).to_pylist()


def item_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase, item: each run of `window` words of each item; an item of fewer words, but not none, is one phrase.

    Null texts have no words. A null item_id is the empty string. Equal rows come once."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for row in _rows(batches):
            words = split_words(row["raw"] or b"")
            for i in range(max(1, len(words) - window + 1) if words else 0):
                phrase = b" ".join(words[i : i + window])
                yield (phrase, row["item"]), len(phrase) + 64

    held = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("raw"))
    return map_rows(held, phrases, _PHRASES).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_hit (words inside an occurrence of a phrase), item_ids (as strings, in their
    order, of the items that occur) and spans (start and length in characters of what to remove, overlaps merged).

    Every row of docs gives a row: a null or empty text has no words, equal rows and null ids give a row each; without items
    nothing is hit. Other columns of docs and items take no part. The phrases are the one thing that every task holds: of
    phrase_bytes of them at most in one pass over the documents; where there are more, further passes look for the rest."""
    phrases = written(item_phrases(items, window), "phrases")
    size = phrases.agg(F.sum(F.length("phrase") + F.length("item") + 64)).first()[0] or 0
    passes = max(1, math.ceil(size / phrase_bytes))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    for i in range(passes):
        some = [(bytes(r.phrase), r.item) for r in phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == i).collect()]
        held = _searched(held, some, i == passes - 1, shard_words)
    return held


def _searched(held: DataFrame, some: list[tuple[bytes, str]], last: bool, shard_words: int) -> DataFrame:
    """A pass for some phrases. The last one gives the result; those before hand on the texts with what they found."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for doc in _shards(_rows(batches), Phrases(some), shard_words):
            spans, items = doc.word_spans(), sorted(doc.items)
            size = 64 + 32 * len(spans) + 16 * len(items)
            if last:
                n_hit = sum(x["length"] for x in spans)
                yield (doc.row["doc_id"], doc.n, n_hit, items, doc.char_spans(spans)), size
            else:
                yield (doc.row["doc_id"], doc.row["raw"], doc.n, spans, items), size + len(doc.row["raw"] or b"")

    return map_rows(held, rows, _RESULT if last else f"doc_id BIGINT, raw BINARY, {_CARRIED}")


def without_spans(text: str, spans: list) -> str:
    """What is left of a text without its spans, a space in place of each."""
    out, at = [], 0
    for x in spans:
        out.append(text[at : x["start"]])
        at = x["start"] + x["length"]
    return " ".join([*out, text[at:]]) if spans else text


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of decontaminate()."""
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    found = decontaminate(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Words by place, phrases of each length that items have, and places where a phrase begins.
CONTAMINATION_SQL = r"""
WITH
item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
phrase AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS said
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM documents),
place AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS said
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)),
found AS (SELECT r, place.n, p, item FROM place JOIN phrase USING (n, said)),
hit AS (
  SELECT r, count(DISTINCT spot) AS n_hit
  FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS spot FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
