"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs n + n * n / QUADRATIC: linear layers plus attention. Documents longer than a
sequence fill whole ones first. The rest, in descending order, go to the sequence of least cost with tokens
left; a piece longer than any place left is cut there. The sequences of a block hold exactly its tokens:
full ones, and for the remainder one for each power of two in it, so that nothing is padded.
Each task packs the rows it reads, so no text is shuffled and no task depends on another.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows, worker_cache

LENGTH = 4096
#: Tokens at which attention costs as much as the linear layers.
QUADRATIC = 8192
#: Tokens that a task packs together.
BLOCK_TOKENS = 2_000_000
END_ID = 2
#: Runs without white space that may be cut by PARTS: no marks, no letters whose kind depends on the Unicode version, no bars (special tokens have them).
SAFE = re.compile("[!-{}~\u00c0-\u024f]+")
#: Fixed value: the pattern of the tokenizer's file, for such runs.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Words, and parts of words, that a Python worker holds, and bytes of them and their ids: fewer take less memory and more time.
CACHE_WORDS, CACHE_BYTES = 800_000, 64 << 20


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Sequences that hold exactly total tokens: full ones, then descending powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(sizes: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, piece's length, sequence, offset), for documents of at least one token each."""
    room = capacities(sum(sizes), length)
    at = 0
    pieces = []
    for doc, size in enumerate(sizes):
        start = 0
        while size - start >= length:
            yield doc, start, length, at, 0
            start, at = start + length, at + 1
        if size > start:
            pieces.append((size - start, doc, start))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    used = [0] * len(room)
    by_cost = [(0.0, s) for s in range(at, len(room))]  # already a heap: equal costs, ascending
    by_room = sorted((-room[s], s) for s in range(at, len(room)))  # also a heap; entries that are out of date are skipped
    for size, doc, start in pieces:
        while size:
            while used[by_room[0][1]] - room[by_room[0][1]] != by_room[0][0]:
                heapq.heappop(by_room)
            passed = []
            if by_room[0][0] + size > 0:  # it fits nowhere whole: cut it where the most is left
                s, n = by_room[0][1], -by_room[0][0]
            else:
                spent, s = heapq.heappop(by_cost)
                while room[s] - used[s] < size:
                    if used[s] < room[s]:
                        passed.append((spent, s))
                    spent, s = heapq.heappop(by_cost)
                n = size
                spent += cost(n)
                if used[s] + n < room[s]:
                    passed.append((spent, s))
            yield doc, start, n, s, used[s]
            used[s] += n
            start, size = start + n, size - n
            if used[s] < room[s]:
                heapq.heappush(by_room, (used[s] - room[s], s))
            for x in passed:
                heapq.heappush(by_cost, x)


class WordTokenizer:
    """A tokenizer whose file cuts text at white space and drops that, run once per distinct run of other characters.

    Runs of SAFE characters, which are composed already, are put into lower case and cut by the file's pattern
    here; only their distinct parts go through the merges. Other runs, and those that may hold a special
    token, go through the whole tokenizer."""

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.merges = self.tokenizer.model.tokenize
        # A byte's character in the merges: its own where that is visible, else the next one from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.characters = {b: 256 + i for i, b in enumerate(hidden)}
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.bytes = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known, parts = self.known, self.parts
        if max(len(known), len(parts)) > self.cache_words or self.bytes > CACHE_BYTES:
            known.clear()
            parts.clear()
            self.bytes = 0
        new = set().union(*split).difference(known)
        safe = SAFE.fullmatch
        plain = [w for w in new if safe(w)]
        if plain:
            cut = list(map(PARTS.findall, " ".join(plain).lower().split(" ")))
            merges, characters = self.merges, self.characters
            for part in set(chain.from_iterable(cut)).difference(parts):
                text = part if part.isascii() else part.encode().decode("latin-1").translate(characters)
                parts[part] = array("I", [x.id for x in merges(text)]).tobytes()
            for word, pieces in zip(plain, cut, strict=True):
                known[word] = parts[pieces[0]] if len(pieces) == 1 else b"".join([parts[p] for p in pieces])
        if len(plain) < len(new):
            rest = list(new.difference(plain))
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        self.bytes += sum(map(len, new)) + sum(len(known[w]) for w in new)
        return [b"".join(map(known.__getitem__, words)) for words in split]


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and row_id, and with_ids the ids themselves (little-endian, 32 bits).

    A null or empty text has the end id alone; every row counts, repeated or not: row_id tells the pieces of
    rows that repeat a doc_id apart. sequence_id and row_id are unique over all tasks of this job, and are dealt
    anew by another. The tokenizer's file is read on the executors, at the same path."""
    end = END_ID.to_bytes(4, "little")

    def rows(batches):
        import gc

        collects = gc.isenabled()
        gc.disable()  # millions of cached strings, and no cycles
        try:
            yield from pieces(batches)
        finally:  # the worker goes on to other jobs
            if collects:
                gc.enable()

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        context = TaskContext.get()
        sequence = row_id = (context.partitionId() if context else 0) << 33
        tokenizer = worker_cache(tokenizer_file, lambda: WordTokenizer(tokenizer_file))
        tokenizer.cache_words = cache_words
        keys, ids, held = [], [], 0

        def packed():
            nonlocal sequence, row_id
            last = sequence
            for doc, start, n, s, offset in assign([len(x) // 4 for x in ids], length):
                part = ids[doc][4 * start : 4 * (start + n)]
                last = max(last, sequence + s + 1)
                row = (keys[doc], start, n, zlib.crc32(part), len(ids[doc]) // 4, sequence + s, offset, row_id + doc)
                yield (*row, part) if with_ids else row, 64 + len(part) * with_ids
            sequence, row_id = last, row_id + len(keys)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = tokenizer.ids([t or "" for t in part.column(1).to_pylist()])
                for key, x in zip(part.column(0).to_pylist(), got, strict=True):
                    keys.append(key)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                if held >= BLOCK_TOKENS:
                    yield from packed()
                    keys, ids, held = [], [], 0
        if keys:
            yield from packed()

    schema = "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, offset LONG, row_id LONG" + ", ids BINARY" * with_ids
    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), rows, schema, keeps=True)
