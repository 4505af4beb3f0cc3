"""Kernels over fingerprints: arrays of 32-bit hashes, as built-in expressions, and Arrow UDFs where those cannot say it."""

from __future__ import annotations

import base64
import struct
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hash of silence, the mask of a query term, the namespace of content ids.
SILENCE, TERM_MASK, NAMESPACE = 627964279, 0xFFFFFFF0, "df7bef46416e4c57a87739b54325ef03"
QUERY_SIZE, QUERY_START, MAX_OFFSET = 120, 80, 80
#: The score is this power of the best aligned agreement.
SCORE_POWER = 2.0


def to_unsigned(hashes: Column) -> Column:
    return F.transform(hashes, lambda x: x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def to_signed(hashes: Column) -> Column:
    return F.transform(hashes, lambda x: F.when(x >= 2**31, x - F.lit(2**32)).otherwise(x).cast("int"))


def extract_query(hashes: Column, size: int = QUERY_SIZE, start: int = QUERY_START) -> Column:
    """The first `size` distinct masked hashes that are not silence, from an offset that leaves enough of them."""
    unsigned = to_unsigned(hashes)
    clean = F.size(F.filter(unsigned, lambda x: x != SILENCE))
    first = F.greatest(F.lit(0), F.least(clean - size, F.lit(start)))
    tail = F.filter(F.slice(unsigned, first + 1, F.greatest(F.size(unsigned), F.lit(1))), lambda x: x != SILENCE)
    terms = F.slice(F.array_distinct(F.transform(tail, lambda x: x.bitwiseAND(F.lit(TERM_MASK)))), 1, max(size, 1))
    return F.when((clean > 0) & F.lit(size > 0), terms).otherwise(F.array().cast("array<bigint>"))


#: Hashes whose bits are counted at a time.
COUNTED = 1 << 18


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of lists of whole numbers: where each begins and ends in the numbers, and these as 32 bits."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], np.asarray(values.to_numpy(zero_copy_only=False)).astype(np.int64).astype(np.uint32)


def bit_votes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For runs of hashes, which may overlap, the number whose bits stand for more hashes than not."""
    out = np.zeros(len(starts), np.int64)
    weights = np.int64(1) << np.arange(32, dtype=np.int64)
    low = 0
    while low < len(starts):
        # Runs, in order, whose hashes are counted together; one long run alone may be more.
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + COUNTED)))
        first, last = int(starts[low]), int(ends[low:high].max())
        bits = np.unpackbits(np.ascontiguousarray(values[first:last]).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts = np.zeros((last - first + 1, 32), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=counts[1:])
        ones = counts[ends[low:high] - first] - counts[starts[low:high] - first]
        out[low:high] = (2 * ones > (ends[low:high] - starts[low:high])[:, None]) @ weights
        low = high
    return out


@F.arrow_udf(T.LongType())
def simhash(hashes: pa.Array) -> pa.Array:
    """Per bit, whether more hashes set it than not; 0 for none, null for null."""
    offsets, values = _lists(hashes)
    return pa.array(bit_votes(values, offsets[:-1], offsets[1:]), mask=np.asarray(hashes.is_null()))


def shingled_simhash(hashes: Column, size: int, step: int) -> Column:
    """A simhash for each window of `size` hashes, at every `step`-th one; the last windows are shorter. Null for null."""
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be positive")

    def run(hashes: pa.Array) -> pa.Array:
        offsets, values = _lists(hashes)
        sizes = np.diff(offsets)
        windows = -(-sizes // step)
        edges = np.concatenate([[0], np.cumsum(windows)])
        starts = np.repeat(offsets[:-1] - edges[:-1] * step, windows) + np.arange(edges[-1]) * step
        ends = np.minimum(starts + size, np.repeat(offsets[1:], windows))
        votes = pa.array(bit_votes(values, starts, ends), pa.int64())
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), votes, mask=hashes.is_null())

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(hashes)


def uuid5(namespace: str, data: Column) -> Column:
    """Version 5 UUID of binary data, in the namespace of 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), data))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def little_endian(value: Column) -> Column:
    """Eight hex digits of a 32-bit number, lowest byte first."""
    h = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def content_id(hashes: Column, version: Column | int = 1) -> Column:
    version = F.lit(version) if isinstance(version, int) else version
    return uuid5(NAMESPACE, F.unhex(F.concat(little_endian(version), F.array_join(F.transform(hashes, little_endian), ""))))


#: Bytes of words, and bytes of texts that are cut into words at a time.
IN_WORDS, CUT = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789")), 1 << 22


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that lie one after another between edges, and how many each text has."""
    inside = IN_WORDS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = edges[edges < len(data)]  # a word ends with its text
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(starts, edges))


def _word_hashes(texts: pa.Array) -> pa.Array:
    held = pc.fill_null(texts, "").cast(pa.large_binary())
    edges = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
    counts, words, low = np.zeros(len(held), np.int64), [pa.array([], pa.large_binary())], 0
    while low < len(held):
        # Texts, in order, that are cut together; one long text alone may be more.
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + CUT, "right")) - 1)
        some, counts[low:high] = _words(data[edges[low] : edges[high]], edges[low : high + 1] - edges[low])
        words.append(some)
        low = high
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()  # each word of a batch is hashed once
    hashes = np.frombuffer(b"".join(md5(w).digest()[3::-1] for w in coded.dictionary.to_pylist()), "<i4")
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(hashes[coded.indices.to_numpy()]), mask=texts.is_null())


#: Hashes of the words (runs of a-z and 0-9) of a text: the first 32 bits of their MD5. Null for null. A filter on the hashes, which Spark adds of
#: itself where they are exploded, would work them out a second time; it does not move below what it must take as not deterministic.
word_hashes = F.arrow_udf(_word_hashes, T.ArrayType(T.IntegerType())).asNondeterministic()


def overlaps(a: Column | str, b: Column | str) -> Column:
    """Whether two fingerprints share a hash; null where one is null."""
    return F.arrays_overlap(a, b)


def subarray(hashes: Column | str, start: int, length: int) -> Column:
    """Hashes from the start-th one on (counted from 0), as many as there are up to a length."""
    return F.slice(hashes, start + 1, length)


def xor_at(a: Column, b: Column, offset: int) -> Column:
    """XOR of two fingerprints, the second moved by an offset; only where both are."""
    left = F.slice(a, 1 + max(0, offset), F.greatest(F.size(a), F.lit(1)))
    right = F.slice(b, 1 + max(0, -offset), F.greatest(F.size(b), F.lit(1)))
    return F.filter(F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y)), lambda x: x.isNotNull())


def parse_array(text: Column) -> Column:
    """An array literal such as {1,-2}; other texts give null."""
    return F.when(text.rlike(r"^\{\s*(-?\d+(\s*,\s*-?\d+)*)?\s*\}$"), F.from_json(F.translate(text, "{}", "[]"), "array<int>"))


#: Aligned pairs of hashes that are compared at a time.
ALIGNED = 1 << 21


def similarity(a: np.ndarray, b: np.ndarray, max_offset: int = MAX_OFFSET) -> float:
    """Of all alignments up to max_offset, the best share of agreeing bits beyond chance, weighted by the overlap, to the power SCORE_POWER."""
    a, b = (np.asarray(x, np.int64).astype(np.uint32) for x in (a, b))
    if len(a) > len(b):  # the offsets are symmetric
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0
    # Row i of the windows is b from i - max_offset on: every alignment of a with b at once.
    held = np.zeros(n + 2 * max_offset, np.uint32)
    inside = np.zeros(n + 2 * max_offset, np.uint8)
    part = b[: n + max_offset]
    held[max_offset : max_offset + len(part)], inside[max_offset : max_offset + len(part)] = part, 1
    windows, masks = (np.lib.stride_tricks.sliding_window_view(x, n) for x in (held, inside))
    best = 0.0
    step = max(1, ALIGNED // n)
    for low in range(0, len(windows), step):
        mask = masks[low : low + step]
        errors = (np.bitwise_count(windows[low : low + step] ^ a) * mask).sum(axis=1, dtype=np.int64)
        overlap = mask.sum(axis=1, dtype=np.int64)
        shares = (1 - errors / (16 * np.maximum(overlap, 1))) * overlap / n
        best = max(best, float(shares.max()))
    return best**SCORE_POWER


@F.arrow_udf(T.DoubleType())
def compare(a: pa.Array, b: pa.Array) -> pa.Array:
    """similarity() of two fingerprint columns; null where one is null. For candidates only."""
    (x_at, x), (y_at, y) = _lists(a), _lists(b)
    known = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    scores = [similarity(x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]) if known[i] else 0.0 for i in range(len(a))]
    return pa.array(np.array(scores, np.float64), mask=~known)


def encode_binary(hashes: np.ndarray, version: int) -> bytes:
    """Magic, format and version bytes, then XOR differences of consecutive hashes."""
    h = np.asarray(hashes, np.int64).astype("<u4")
    return b"Fp" + bytes((1, version)) + np.append(h[:1], h[1:] ^ h[:-1]).astype("<u4").tobytes()


def decode_binary(data: bytes) -> tuple[int, np.ndarray]:
    if len(data) < 4 or data[:2] != b"Fp" or data[2] != 1 or len(data) % 4:
        raise ValueError("not a binary fingerprint")
    return data[3], np.bitwise_xor.accumulate(np.frombuffer(data, "<u4", offset=4)).astype(np.uint32)


def _gap_symbols(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaps between set bits of the hashes' XOR differences, a zero behind each hash, and where each row's symbols begin and end."""
    differences = values.copy()
    differences[1:] ^= values[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    differences[starts] = values[starts]
    bits = np.unpackbits(differences.astype("<u4").view(np.uint8), bitorder="little")
    places = np.flatnonzero(bits)
    owner, bit = places >> 5, places & 31
    before = np.append(-1, bit[:-1])
    before[np.append(True, owner[1:] != owner[:-1])[: len(owner)]] = -1
    symbols = np.zeros(len(places) + len(values), np.int64)
    symbols[np.arange(len(places)) + owner] = bit - before[: len(bit)]
    ends = np.searchsorted(owner, np.arange(len(values)), "right") + np.arange(1, len(values) + 1)
    edges = np.append(0, ends)[offsets]
    return symbols, edges[:-1], edges[1:]


def _text_form(symbols: np.ndarray, count: int, version: int) -> str:
    raw = bytes((version,)) + struct.pack(">I", count)[1:]
    raw += _bits(np.minimum(symbols, 7), 3) + _bits(symbols[symbols >= 7] - 7, 5)
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def encode_legacy(hashes: np.ndarray, version: int = 1) -> str:
    """The compact text form: gaps between set bits of XOR differences, 3 bits each, longer gaps in a second stream of 5 bits."""
    h = np.asarray(hashes, np.int64).astype(np.uint32)
    return _text_form(_gap_symbols(h, np.array([0, len(h)]))[0] if len(h) else np.zeros(0, np.int64), len(h), version)


def _bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of some bits each, lowest bit first, up to a whole byte."""
    planes = (values[:, None] >> np.arange(width)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _numbers(bits: np.ndarray, width: int) -> np.ndarray:
    return bits[: len(bits) // width * width].reshape(-1, width) @ (1 << np.arange(width))


def decode_legacy(text: str) -> tuple[int, np.ndarray]:
    """Version and hashes of the compact text form; ValueError where it breaks off."""
    raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    if len(raw) < 4:
        raise ValueError("too short")
    count = int.from_bytes(raw[1:4], "big")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=4), bitorder="little")
    gaps = _numbers(bits, 3)
    ends = np.flatnonzero(gaps == 0)
    if len(ends) < count:
        raise ValueError("the gaps break off")
    used = int(ends[count - 1]) + 1 if count else 0
    gaps, ends = gaps[:used], ends[:count]
    more = _numbers(bits[-(-3 * used // 8) * 8 :], 5)
    long = np.flatnonzero(gaps == 7)
    if len(long) > len(more):
        raise ValueError("the long gaps break off")
    gaps[long] += more[: len(long)]
    owner = np.cumsum(gaps == 0)
    total = np.cumsum(gaps)
    place = total - np.append(0, total[ends])[owner]  # bits from the hash's lowest one on
    mark = gaps > 0
    if (place > 32).any():
        raise ValueError("a gap leads beyond 32 bits")
    values = np.bincount(owner[mark], 2.0 ** (place[mark] - 1), count).astype(np.uint32) if count else np.zeros(0, np.uint32)
    return raw[0], np.bitwise_xor.accumulate(values)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32).view(np.int32)


def _hash_lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) for x in rows], np.int64)
    values = np.concatenate([np.zeros(0, np.int32), *[x for x in rows if x is not None]])
    edges = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(edges, pa.array(values, pa.int32()), mask=pa.array([x is None for x in rows], pa.bool_()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def decode_text(text: pa.Array) -> pa.Array:
    """Hashes of the compact text form; null where it is broken or not of version 1."""

    def one(x):
        try:
            version, hashes = decode_legacy(x)
        except (ValueError, TypeError):
            return None
        return _signed(hashes) if version == 1 else None

    return _hash_lists([None if x is None else one(x) for x in text.to_pylist()])


#: Hashes whose text forms are made at a time: a hash has some sixteen gaps, each a number in several arrays.
ENCODED = 1 << 16


def text_forms(values: np.ndarray, offsets: np.ndarray, known: list[bool]) -> list[str | None]:
    """The text form of each row of hashes, null for unknown ones. Rows are taken together up to ENCODED hashes; one long row alone may be more."""
    out = []
    low = 0
    while low < len(known):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + ENCODED, "right")) - 1)
        part = offsets[low : high + 1] - offsets[low]
        some = values[offsets[low] : offsets[high]]
        symbols, first, last = _gap_symbols(some, part) if len(some) else (np.zeros(0, np.int64), part[:-1], part[:-1])
        rows = zip(first.tolist(), last.tolist(), np.diff(part).tolist(), known[low:high], strict=True)
        out += [_text_form(symbols[a:b], n, 1) if yes else None for a, b, n, yes in rows]
        low = high
    return out


@F.arrow_udf(T.StringType())
def encode_text(hashes: pa.Array) -> pa.Array:
    offsets, values = _lists(hashes)
    return pa.array(text_forms(values, offsets, hashes.is_valid().to_pylist()), pa.string())


@F.arrow_udf(T.BinaryType())
def compress(hashes: pa.Array) -> pa.Array:
    """The binary form, as a zstd frame."""
    offsets, values = _lists(hashes)
    at, known = offsets.tolist(), hashes.is_valid().to_pylist()
    return pa.array([pa.compress(encode_binary(values[at[i] : at[i + 1]], 1), codec="zstd", asbytes=True) if known[i] else None for i in range(len(hashes))], pa.binary())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def decompress(data: pa.Array) -> pa.Array:
    """Hashes of a zstd frame of the binary form; null where it is broken."""

    def one(x):
        try:
            return _signed(decode_binary(pa.input_stream(pa.py_buffer(x), compression="zstd").read())[1])
        except (ValueError, TypeError, OSError):
            return None

    return _hash_lists([None if x is None else one(x) for x in data.to_pylist()])


def processed(text: Column) -> Column:
    """What is kept of a submitted text form: hashes, content id and simhash; null where it is broken or not of version 1."""
    hashes = decode_text(text)
    return F.when(hashes.isNotNull(), F.struct(hashes.alias("hashes"), content_id(hashes).alias("gid"), simhash(hashes).alias("simhash")))
