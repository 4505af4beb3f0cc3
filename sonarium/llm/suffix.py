"""Removal of long repeated byte strings, by a hash-compared suffix sort.

Every window of SPAN bytes belongs to the ANCHOR-byte string within it that hashes lowest, so equal windows
belong to equal anchors, at the same offset. Runs of windows with one anchor form a segment. Anchors that
occur once need no look; the segments of the others meet in buckets by anchor hash. There the text right of
the anchors is sorted, and the reversed text left of them: a vectorised mergesort whose comparisons find the
common extension by binary search over prefix polynomial hashes. Bytes confirm every common extension that
counts. Windows are equal where both their parts lie in one run of sufficiently long extensions.
The first window of a class stays, the others go.

One plan does it: texts are dealt by document once, and that exchange is read by the scan for anchors, by
the cutting of segments, and by the removal. Tasks merge what they hold twice before they send it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonarium.llm.arrow import release, struct
from sonarium.llm.storage import bounded_batches, partitions

SPAN, ANCHOR = 100, 32
OFFSETS = SPAN - ANCHOR + 1
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes that are hashed at a time; longer texts are hashed piece by piece.
PIECE = 1 << 19
#: Anchors, and segments with their bytes, that a task holds before it merges and sends them.
HOLD, HOLD_TEXTS = 500_000, 60_000
#: Buckets for each shuffle partition; there are two tasks for each, and a task holds one bucket at a time.
BUCKETS = 16
_POSITION = np.uint64((1 << 28) - 1)
#: Keys of rows without an id begin here.
NO_ID = 2**62


class Poly:
    """Prefix polynomial hashes modulo 2**64 of arrays of up to `size` bytes."""

    def __init__(self, size: int):
        self.grow(size)

    def grow(self, size: int) -> None:
        powers = np.full(size + 1, BASE, np.uint64)
        inverse = np.full(size + 1, BASE_INVERSE, np.uint64)
        powers[0] = inverse[0] = 1
        self.powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self.grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=out[1:])
        return out

    def strings(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return (prefix[start + length] - prefix[start]) * self.inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, poly: Poly) -> tuple[np.ndarray, ...]:
    """Of the texts data[start:end]: each segment's first window, its number of windows, its anchor, and the anchor's hash."""
    n = len(data) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not (ends - starts >= SPAN).any():
        return none, none, none, none.astype(np.uint64)
    prefix = poly.prefix(data)
    m = len(data) - ANCHOR + 1
    hashes = mixed((prefix[ANCHOR:] - prefix[:-ANCHOR]) * poly.inverse[:m])
    low = (hashes & ~_POSITION) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= OFFSETS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if OFFSETS > width:
        low = np.minimum(low[: width - OFFSETS], low[OFFSETS - width :])
    anchor = (low & _POSITION).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    long = ends - starts >= SPAN
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - SPAN + 1, -1)
    valid = np.cumsum(edge[:n]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    new[starts[long]] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    counts = np.cumsum(valid)
    count = counts[stop - 1] - counts[first] + 1
    at = anchor[first]
    return first, count, at, hashes[at]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of an array of strings: bytes, rows, their starts and ends in the bytes, and what to add to a start to get the place in the row."""
    size = len(texts)
    if not size or texts.buffers()[2] is None:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + size + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    at = 0
    while at < size:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        low, high = offsets[at], offsets[stop]
        if high - low <= PIECE:
            yield data[low:high], np.arange(at, stop), offsets[at:stop] - low, offsets[at + 1 : stop + 1] - low, low - offsets[at:stop]
        else:
            for cut in range(0, int(high - low) - SPAN + 1, PIECE):
                part = data[low + cut : min(low + cut + PIECE + SPAN - 1, high)]
                yield part, np.array([at]), np.array([0]), np.array([len(part)]), np.array([cut])
        at = stop


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together: high bytes of small numbers compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


_PARCEL = struct("bucket INT, kind INT, a BINARY, b BINARY, c BINARY, d BINARY, e BINARY")


def _parcels(kind: int, buckets: np.ndarray, columns: list[np.ndarray], texts: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, as one row of packed columns for each bucket."""
    if not len(buckets):
        return
    edges = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    rows = []
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(buckets)], strict=True):
        packed = [_planes(np.ascontiguousarray(c[low:high])) for c in columns]
        packed += [b"".join(texts[low:high])] if texts is not None else []
        rows.append((int(buckets[low]), kind, *packed, *[None] * (5 - len(packed))))
    schema = to_arrow_schema(_PARCEL)
    for i in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[i : i + 500], strict=True), schema, strict=True)], schema=schema)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns begins a new group."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


_FLAG = struct("key LONG, start INT")


def _send_anchors(buckets: int):
    """Texts to parcels: kind 0 has one segment per anchor hash, kind 1 segments whose anchor the task has seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        poly, held, size = Poly(PIECE + SPAN), [], 0

        def flush():
            h, key, start = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, key, start = h[order], key[order], start[order]
            new = _groups(h)
            again = ~new
            again[:-1] |= again[1:]
            bucket = _bucket(h, buckets)
            yield from _parcels(0, bucket[new], [h[new], key[new], start[new]])
            yield from _parcels(1, bucket[again], [h[again], key[again], start[again]])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            for data, rows, starts, ends, shift in pieces(batch.column("text")):
                first, _, _, h = segments(data, starts, ends, poly)
                row = np.searchsorted(starts, first, "right") - 1
                held.append((h, keys[rows[row]], (first + shift[row]).astype(np.uint32)))
                size += len(h)
                if size >= HOLD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: str) -> Iterator[list[tuple]]:
    """The rows of one bucket after another; a partition's rows are sorted by bucket, so that a task holds one of its buckets."""
    held, last = [], None
    for batch in batches:
        for bucket, *row in zip(batch.column("bucket").to_pylist(), *[batch.column(c).to_pylist() for c in columns.split()], strict=True):
            if bucket != last and held:
                yield held
                held = []
            last = bucket
            held.append(row)
    if held:
        yield held


def _flag_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parcels to the segments whose anchors occur more than once."""
    release()
    schema = to_arrow_schema(_FLAG)

    def out(key, start):
        for i in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 200_000], pa.int64()), pa.array(start[i : i + 200_000].astype(np.int64), pa.int64()).cast(pa.int32(), safe=False)], schema=schema)

    for rows in _by_bucket(batches, "kind a b c"):
        sent = []
        for kind, a, b, c in rows:
            got = _from_planes(a, "u8"), _from_planes(b, "i8"), _from_planes(c, "u4")
            if kind == 1:
                yield from out(got[1], got[2])
            else:
                sent.append(got)
        if sent:
            h, key, start = (np.concatenate(c) for c in zip(*sent, strict=True))
            order = np.argsort(h, kind="stable")
            h = h[order]
            again = ~_groups(h)
            again[:-1] |= again[1:]
            yield from out(key[order[again]], start[order[again]])


#: What is known of a segment: anchor hash, document, check value of its text, first window, windows, and the anchor's offset.
_SEGMENT = [("h", "u8"), ("key", "i8"), ("v", "u4"), ("start", "u4"), ("count", "u1"), ("off", "u1")]


def _same_segments(x: np.ndarray, content: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of segments of equal content, which one is first (by document, then start), and which are repeats of an earlier one."""
    order = np.lexsort((x["start"], x["key"], x["off"], x["count"], content, x["h"]))
    s = x[order]
    new = _groups(s["h"], content[order], s["count"], s["off"])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for i in np.flatnonzero(~new).tolist():
        if texts[order[i]] != texts[lead[i]]:  # the hashes collide: it stands for itself
            lead[i] = order[i]
    first = np.unique(lead)
    repeat = order[(lead != order) & ((x["key"][lead] != x["key"][order]) | (x["start"][lead] != x["start"][order]))]
    return first, repeat


def _send_segments(buckets: int):
    """Texts with flagged starts to parcels: kind 2 has segments, kind 3 windows that the task knows to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        poly, held, contents, texts = Poly(PIECE + SPAN), [], [], []

        def flush():
            x, content = np.concatenate(held), np.concatenate(contents)
            first, repeat = _same_segments(x, content, texts)
            for kind, chosen in ((2, first), (3, repeat)):
                chosen = chosen[np.argsort(x["h"][chosen], kind="stable")]
                part = x[chosen]
                small = np.stack([part["count"], part["off"]], axis=1) if len(part) else np.zeros((0, 2), np.uint8)
                columns = [part["h"], part["key"], np.stack([part["v"], part["start"]], axis=1), np.ascontiguousarray(small)]
                yield from _parcels(kind, _bucket(part["h"], buckets), columns, [texts[i] for i in chosen.tolist()] if kind == 2 else None)

        for batch in batches:
            keys, column, flags = batch.column("key").to_numpy(), batch.column("text"), batch.column("flags")
            checks: dict[int, int] = {}
            ends_of = flags.offsets.to_numpy().astype(np.int64)
            values = flags.values.to_numpy().astype(np.int64)
            wanted = np.repeat(np.arange(len(flags)), np.diff(ends_of)) << 32 | values[ends_of[0] : ends_of[-1]] & 0xFFFFFFFF
            for data, rows, starts, ends, shift in pieces(column):
                first, count, anchor, h = segments(data, starts, ends, poly)
                row = np.searchsorted(starts, first, "right") - 1
                keep = np.isin(rows[row].astype(np.int64) << 32 | (first + shift[row]), wanted)
                first, count, anchor, h, row = first[keep], count[keep], anchor[keep], h[keep], row[keep]
                if not len(first):
                    continue
                for r in np.unique(rows[row]).tolist():
                    if r not in checks:
                        checks[r] = zlib.crc32(column[r].as_buffer())
                x = np.zeros(len(first), _SEGMENT)
                x["h"], x["key"], x["start"], x["count"], x["off"] = h, keys[rows[row]], first + shift[row], count, anchor - first
                x["v"] = [checks[r] for r in rows[row].tolist()]
                raw = data.tobytes()
                texts += [raw[a:b] for a, b in zip(first.tolist(), (first + count + SPAN - 1).tolist(), strict=True)]
                held.append(x)
                contents.append(poly.strings(poly.prefix(data), first, count + SPAN - 1))
                if len(texts) >= HOLD_TEXTS:
                    yield from flush()
                    held, contents, texts = [], [], []
        if texts:
            yield from flush()

    return run


def common_extension(poly: Poly, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the strings at a and b agree, `most` at most: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = poly.strings(prefix, a, mid) == poly.strings(prefix, b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, poly: Poly) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings data[start:start + length], and how far each agrees with the one before it.

    A bottom-up mergesort over all runs at once: each string's rank in the neighbouring run is found by binary
    search. Should the bytes contradict the hashes, the strings are sorted by their bytes."""
    n, prefix = len(starts), poly.prefix(data)
    padded = np.append(data, 0)
    order, width = np.arange(n), 1

    def less(i: np.ndarray, j: np.ndarray, on_tie: np.ndarray) -> np.ndarray:
        most = np.minimum(lengths[i], lengths[j])
        ext = common_extension(poly, prefix, starts[i], starts[j], most)
        ends = ext == most
        tie = ends & (lengths[i] == lengths[j])
        at = np.where(ends, 0, ext)
        return np.where(tie, on_tie, np.where(ends, lengths[i] < lengths[j], padded[starts[i] + at] < padded[starts[j] + at]))

    while width < n:
        at = np.arange(n)
        run = at // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        low, high = np.minimum(other, n), np.minimum(other + width, n)
        begin = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            before = less(order[mid], order[open_], ~left[open_])  # of equals, the left run's come first
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = (run // 2) * 2 * width + at % width + low - begin
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    most = np.minimum(lengths[order[1:]], lengths[order[:-1]]) if n else np.zeros(0, np.int64)
    ext = common_extension(poly, prefix, starts[order[1:]], starts[order[:-1]], most)
    if not _confirmed(padded, starts[order[:-1]], starts[order[1:]], ext, most):
        raw = data.tobytes()
        strings = [raw[s : s + k] for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
        order = np.array(sorted(range(n), key=lambda i: strings[i]), np.int64)
        ext = np.array([next((k for k, (x, y) in enumerate(zip(strings[i], strings[j], strict=False)) if x != y), min(len(strings[i]), len(strings[j]))) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)], np.int64)
    return order, np.append(0, ext) if n else ext


def _confirmed(data: np.ndarray, a: np.ndarray, b: np.ndarray, ext: np.ndarray, most: np.ndarray) -> bool:
    """Whether bytes bear out that a and b agree just so far, and that the strings ascend."""
    for low in range(0, len(a), 20_000):
        x, y, e, m = (v[low : low + 20_000] for v in (a, b, ext, most))
        steps = np.arange(int(e.max(initial=0)))
        inside = steps[None, :] < e[:, None]
        if ((data[np.where(inside, x[:, None] + steps, 0)] != data[np.where(inside, y[:, None] + steps, 0)]) & inside).any():
            return False
        cut = e < m
        if (data[x[cut] + e[cut]] >= data[y[cut] + e[cut]]).any():
            return False
    return True


def repeated_windows(x: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct segments: pairs of a segment's index and the index of a window in it that stands earlier elsewhere."""
    n = len(x)
    order = np.lexsort((x["start"].astype(np.int64) + x["off"], x["key"]))
    x, texts = x[order], [texts[i] for i in order.tolist()]
    place = x["start"].astype(np.int64) + x["off"]
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    off, count = x["off"].astype(np.int64), x["count"].astype(np.int64)
    poly = Poly(len(data) + 1)
    right, right_ext = suffix_sort(data, begin + off, sizes - off, poly)
    total = len(data)
    left, left_ext = suffix_sort(data[::-1], total - (begin + off), off, poly)
    seg, window = [], []
    right_id, left_id = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(OFFSETS):
        has = np.flatnonzero((off - count < o) & (o <= off))
        if len(has) < 2:
            continue
        right_id[right] = np.cumsum(right_ext < SPAN - o)
        left_id[left] = np.cumsum(left_ext < o)
        both = right_id[has] * (n + 1) + left_id[has]
        _, first, which = np.unique(both, return_index=True, return_inverse=True)
        lead = has[first[which]]
        late = (x["key"][lead] != x["key"][has]) | (place[lead] != place[has])
        seg.append(order[has[late]])
        window.append((off[has] - o)[late])
    return (np.concatenate(seg), np.concatenate(window)) if seg else (np.zeros(0, np.int64),) * 2


_MARK = struct("key LONG, v LONG, start LONG, count INT")


def _mark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parcels of segments to runs of repeated windows, one bucket after another."""
    release()
    schema = to_arrow_schema(_MARK)
    for rows in _by_bucket(batches, "kind a b c d e"):
        for columns in _marks(rows):
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(np.int64), pa.int64()).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _marks(rows: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """key, v, start and count of the repeated windows in a bucket's parcels."""
    sent, texts = [], []
    for kind, *packed in rows:
        h = _from_planes(packed[0], "u8")
        x = np.zeros(len(h), _SEGMENT)
        pair = _from_planes(packed[2], "u8").view("u4").reshape(-1, 2)
        small = _from_planes(packed[3], "u2").view("u1").reshape(-1, 2)
        x["h"], x["key"], x["v"], x["start"], x["count"], x["off"] = h, _from_planes(packed[1], "i8"), pair[:, 0], pair[:, 1], small[:, 0], small[:, 1]
        if kind == 3:
            yield x["key"], x["v"], x["start"], x["count"]
            continue
        ends = np.cumsum(x["count"].astype(np.int64) + SPAN - 1).tolist()
        texts += [packed[4][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        sent.append(x)
    if not sent:
        return
    x = np.concatenate(sent)
    poly = Poly(1 << 16)
    content = np.empty(len(x), np.uint64)
    at = 0
    while at < len(x):  # hashes of the segments' bytes, some at a time
        part = texts[at : at + 20_000]
        sizes = np.array([len(t) for t in part], np.int64)
        data = np.frombuffer(b"".join(part), np.uint8)
        content[at : at + len(part)] = poly.strings(poly.prefix(data), np.cumsum(sizes) - sizes, sizes)
        at += len(part)
    first, repeat = _same_segments(x, content, texts)
    yield tuple(x[c][repeat] for c in ("key", "v", "start", "count"))
    first = first[np.argsort(x["h"][first], kind="stable")]
    new = _groups(x["h"][first])
    alone = new & np.append(new[1:], True)
    # Groups of an anchor stay together; some at a time.
    chosen = first[~alone]
    cuts = [0]
    starts = np.flatnonzero(_groups(x["h"][chosen])) if len(chosen) else []
    for s in [*starts[1:], len(chosen)] if len(chosen) else []:
        if s - cuts[-1] >= 15_000 or s == len(chosen):
            cuts.append(int(s))
    for low, high in zip(cuts, cuts[1:], strict=False):
        some = chosen[low:high]
        seg, window = repeated_windows(x[some], [texts[i] for i in some.tolist()])
        order = np.lexsort((window, seg))
        seg, window = seg[order], window[order]
        new = _groups(seg, window - np.arange(len(window)))
        edge = np.flatnonzero(new)
        rows_of = x[some[seg[edge]]]
        yield rows_of["key"], rows_of["v"], rows_of["start"].astype(np.int64) + window[edge], np.diff(np.append(edge, len(seg)))


def _covered(marks: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under runs of windows (start, number)."""
    out: list[list[int]] = []
    for start, count in sorted(marks):
        end = min(size, start + count - 1 + SPAN)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, their other columns packed in the struct `kept_row`, with key, text (null: empty) and marks: runs of windows (v, start, count) that stand earlier, v being the CRC-32 of the text they belong to.

    A window stands earlier if a smaller doc_id holds it, or its own document at an earlier start. Rows without
    an id come last, in the order of a hash of their texts, each text a document of its own. Rows that repeat an
    id and a text are one document: none is a repeat of the other. Rows with one id and different texts are
    versions of one document: a window stays at its smallest start among them. Ids are below NO_ID. Other columns
    may have any name; an empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(whole), 2))
    base = docs.select(key.alias("key"), whole.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("kept_row")).repartition(n, "key")
    deal = lambda df: df.repartition(2 * n, "bucket").sortWithinPartitions("bucket")
    flags = deal(base.mapInArrow(_send_anchors(BUCKETS * n), _PARCEL)).mapInArrow(_flag_anchors, _FLAG).groupBy("key").agg(F.collect_set("start").alias("flags"))
    segs = deal(base.join(flags, "key").mapInArrow(_send_segments(BUCKETS * n), _PARCEL))
    marks = segs.mapInArrow(_mark_windows, _MARK).groupBy("key").agg(F.collect_list(F.struct("v", "start", "count")).alias("marks"))
    return base.join(marks, "key", "left")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end in bytes), and with_text the input's other columns (kept_row) and what is left of the text (kept_text; characters that were cut in two are dropped)."""
    found = repeated_spans(docs if with_text else docs.select(doc_id, text), doc_id, text)
    schema = T.StructType.fromDDL("doc_id LONG, n_bytes LONG, n_removed LONG, n_spans LONG, kept_sha256 STRING, spans ARRAY<STRUCT<start: LONG, end: LONG>>")
    if with_text:
        schema = T.StructType([*schema.fields, found.schema["kept_row"], T.StructField("kept_text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                ids = part.column("kept_row").field(doc_id).to_pylist()
                for key, value, marks in zip(ids, part.column("text").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    raw, kept, last = value.encode("utf-8", "surrogatepass"), [], 0
                    v = zlib.crc32(raw) if marks else 0
                    spans = _covered([(m["start"], m["count"]) for m in marks or () if m["v"] == v], len(raw))
                    for a, b in spans:
                        kept.append(raw[last:a])
                        last = b
                    kept.append(raw[last:])
                    left = b"".join(kept)
                    rows.append((key, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans], left.decode("utf-8", "ignore")))
                columns = [pa.array(list(c), arrow[i].type) for i, c in enumerate(list(zip(*rows, strict=True))[:6])]
                if with_text:
                    columns += [part.column("kept_row").cast(arrow.field("kept_row").type), pa.array([r[6] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return found.mapInArrow(run, schema)
