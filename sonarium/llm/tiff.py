"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories in either byte order, decodes stored, PackBits, LZW and
deflate strips or tiles, undoes horizontal differencing (8, 16 and 32 bit) and that of floating-point samples,
and crops tiles at the right and lower edge. Samples of 1, 2 and 4 bits come out as one byte each. A page
whose strips or tiles are too few, too many or too short, or whose size its bytes cannot hold, is an error,
never a page with holes. LZW code positions depend only on how many codes follow the last clear code, so a
whole run of codes is cut out of the bit stream with numpy before the table is rebuilt.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.llm.arrow import map_rows
from sonarium.llm.arrow import struct as columns_of

STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
#: Fixed values of the format: bytes of each field type, by its code.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Fixed values of the format: LZW codes after a clear code that have 9, 10 and 11 bits; later ones have 12.
LZW_STEPS = ((254, 9), (512, 10), (1024, 11))
LZW_RUN = 3837
#: Bytes that one stored byte can become, by compression: more than the format allows is no image.
EXPANSION = {STORED: 1, LZW: 2600, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}


def _code_widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    steps = [np.full(k, w, np.int64) for k, w in LZW_STEPS]
    return np.concatenate([*steps, np.full(max(0, n - sum(k for k, _ in LZW_STEPS)), 12, np.int64)])[:n]


_WIDTHS = _code_widths(LZW_RUN + 2)


class TiffError(ValueError):
    """The bytes are not a file that this reader can decode."""


def lzw_encode(data: bytes) -> bytes:
    codes, ends, table, free = [CLEAR], [], {}, 258
    if data:
        it = iter(data)
        held = next(it)
        for c in it:
            key = held << 8 | c
            code = table.get(key)
            if code is not None:
                held = code
                continue
            codes.append(held)
            table[key] = free
            free += 1
            held = c
            if free > 257 + LZW_RUN:
                ends.append(len(codes))
                codes.append(CLEAR)
                table, free = {}, 258
        codes.append(held)
    codes.append(END)
    widths, at = np.empty(len(codes), np.int64), 1
    widths[0] = 9
    for end in [*ends, len(codes) - 1]:  # each run has its clear or end code as the last
        widths[at : end + 1] = _WIDTHS[: end + 1 - at]
        at = end + 1
    values = np.array(codes, np.int64)
    shifts = np.arange(11, -1, -1)
    bits = (values[:, None] >> shifts) & 1
    return np.packbits(bits[shifts < widths[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, limit: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    at, total, have, most = 0, len(data) * 8, 0, LZW_RUN + 2
    while have < limit:
        widths = _code_widths(most)
        starts = np.concatenate([[0], np.cumsum(widths)])
        n = int(np.searchsorted(starts, total - at, "right")) - 1
        if n <= 0:
            break
        where, width = at + starts[:n], widths[:n]
        codes = (words[where >> 3] >> (24 - (where & 7) - width)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        if stop == most:  # a writer that goes on with a full table, without a clear code
            most = len(data)
            continue
        most, table, last = LZW_RUN + 2, base.copy(), b""
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise TiffError("an LZW code points beyond the table")
            out.append(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            have += len(entry)
        if stop == n or codes[stop] == END:
            break
        at += int(starts[stop + 1])
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    at = 0
    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : m.start()])
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, at, n, have = [], 0, len(data), 0
    while at < n and have < limit:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
            continue
        have += len(out[-1])
    return b"".join(out)


def _unpack(data: bytes, compression: int, limit: int) -> bytes:
    if compression == STORED:
        return data
    if compression == LZW:
        return lzw_decode(data, limit)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, limit)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if compression == PACKBITS:
        return packbits_decode(data, limit)
    raise TiffError(f"compression {compression} is not supported")


def _pack(data: bytes, compression: int) -> bytes:
    return {STORED: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}[compression](data)


def read_tiff(data: bytes) -> Iterator[dict]:
    """The pages of a file, in the order of its directories. samples: rows of interleaved samples, those of several bytes little-endian, those of less than 8 bits one byte each."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                size = FIELD_BYTES.get(kind, 0) * count
                where = at + 10 + 12 * i
                if size > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                if kind in (1, 3, 4):
                    tags[tag] = np.frombuffer(data, order + {1: "u1", 3: "u2", 4: "u4"}[kind], count, where).tolist()
            following = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
            page = _page(data, tags, order)
        except (struct.error, KeyError, IndexError, ValueError) as e:
            raise e if isinstance(e, TiffError) else TiffError(f"broken directory at {at}: {e}") from e
        yield page
        at = following


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise TiffError(message)


def _cells(raw: bytes, rows: int, w: int, deep: int, bits: int, kind: np.dtype, predictor: int, order: str) -> np.ndarray:
    """The samples of an unpacked strip or tile: rows, columns, channels."""
    if bits < 8:  # rows begin at whole bytes
        line = -(-w * deep * bits // 8)
        planes = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : w * deep * bits]
        return np.packbits(planes.reshape(rows, w * deep, bits), axis=2).reshape(rows, w, deep) >> (8 - bits)
    if predictor == 3:  # rows of byte planes, the highest first, as differences
        size = bits // 8
        lines = np.frombuffer(raw, np.uint8, rows * w * deep * size).reshape(rows, w * size, deep)
        planes = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(rows, size, w, deep)
        return np.ascontiguousarray(planes.transpose(0, 2, 3, 1)).view(f">u{size}").reshape(rows, w, deep)
    part = np.frombuffer(raw, kind, rows * w * deep).reshape(rows, w, deep)
    return np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else part


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> dict:
    width, height = tags[256][0], tags[257][0]
    channels, depths = tags.get(277, [1])[0], tags.get(258, [1])
    bits = depths[0]
    compression, predictor, planes = tags.get(259, [STORED])[0], tags.get(317, [1])[0], tags.get(284, [1])[0]
    _need(width > 0 and height > 0 and channels > 0, f"a page of {width} x {height} x {channels}")
    _need(bits in (1, 2, 4, 8, 16, 32) and set(depths) == {bits}, f"{depths} bits are not supported")
    _need(predictor in {1, *([2] if bits >= 8 else []), *([3] if bits >= 16 else [])}, f"predictor {predictor} of {bits} bits is not supported")
    _need(compression in EXPANSION, f"compression {compression} is not supported")
    kind = np.dtype(np.uint8 if bits <= 8 else f"{order}u{bits // 8}")
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, [height])[0], height))
    _need(w > 0 and h > 0, f"strips or tiles of {w} x {h}")
    starts, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    deep = channels if planes == 1 else 1
    across, down, separate = -(-width // w), -(-height // h), channels // deep
    _need(len(starts) == len(counts) == across * down * separate, f"{len(starts)} strips or tiles with {len(counts)} sizes, not {across * down * separate}")
    _need(all(a + n <= len(data) for a, n in zip(starts, counts, strict=True)), "a strip or tile lies beyond the file")
    held = sum(counts) * EXPANSION[compression] + 4096
    _need(height * -(-width * channels * bits // 8) <= held and w * h <= held * 8, f"{width} x {height} samples in {sum(counts)} bytes")
    reverse = tags.get(266, [1])[0] == 2
    image = np.zeros((height, width, channels), kind.newbyteorder("<"))
    for k, (start, count) in enumerate(zip(starts, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        need = rows * -(-w * deep * bits // 8)
        raw = data[start : start + count]
        if reverse:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8)), bitorder="little").tobytes()
        raw = _unpack(raw, compression, need)
        _need(len(raw) >= need, f"strip or tile {k} is short: {len(raw)} of {need} bytes")
        part = _cells(raw, rows, w, deep, bits, kind, predictor, order)[: height - y, : width - x]
        image[y : y + rows, x : x + w, plane : plane + deep] = part
    return {"width": width, "height": height, "channels": channels, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "samples": image.tobytes()}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 64, order: str = "<") -> bytes:
    """A file of 8-bit pages, each an array of rows, columns and channels."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        height, width, channels = image.shape
        parts = []
        w, h = tile or (width, strip_rows)
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = image[y : y + h, x : x + w]
                if tile and part.shape[:2] != (h, w):
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                parts.append(_pack(part.tobytes(), compression))
        starts = []
        for part in parts:
            starts.append(len(out))
            out += part + b"\0" * (len(part) & 1)
        fields = {256: [width], 257: [height], 258: [8] * channels, 259: [compression], 262: [2 if channels == 3 else 1], 277: [channels], 284: [1], 317: [predictor]}
        fields |= {322: [w], 323: [h], 324: starts, 325: [len(p) for p in parts]} if tile else {273: starts, 278: [h], 279: [len(p) for p in parts]}
        entries = []
        for tag, values in sorted(fields.items()):
            kind, code = (4, "I") if tag in (256, 257, 273, 279, 324, 325) else (3, "H")
            body = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(body) > 4:
                where = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Bytes of a row of the pages that carry a payload: 192 grey samples, or 64 of three colours.
ROW_BYTES = 192
#: How a payload is stored, by its CRC-32: compression, predictor, tile, channels, rows of a page, byte order.
LAYOUTS = (
    (DEFLATE, 1, None, 3, 4096, "<"),
    (PACKBITS, 1, None, 1, 4096, ">"),
    (LZW, 1, None, 3, 4096, "<"),
    (LZW, 2, (32, 32), 3, 4096, ">"),
    (DEFLATE, 2, (64, 16), 1, 4096, "<"),
    (DEFLATE, 2, None, 3, 256, ">"),
    (PACKBITS, 1, (64, 32), 1, 1024, "<"),
    (STORED, 1, (32, 16), 3, 4096, "<"),
)


def payload_tiff(payload: bytes) -> bytes:
    """Stores bytes, a positive multiple of ROW_BYTES, losslessly; equal bytes give equal files."""
    compression, predictor, tile, channels, rows, order = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // channels, channels)
    return write_tiff([image[i : i + rows] for i in range(0, len(image), rows)], compression, predictor, tile, order=order)


def tile_hash(page: dict) -> str:
    """64 bits, one for each cell of an 8 x 8 grid: whether its mean is above the page's."""
    kind = np.uint8 if page["bits"] <= 8 else f"<u{page['bits'] // 8}"
    image = np.frombuffer(page["samples"], kind).reshape(page["height"], -1)
    rows = np.unique(np.arange(8) * image.shape[0] // 8)
    columns = np.unique(np.arange(8) * image.shape[1] // 8)
    cells = np.add.reduceat(np.add.reduceat(image, rows, axis=0, dtype=np.int64), columns, axis=1)
    sizes = np.diff([*rows, image.shape[0]])[:, None] * np.diff([*columns, image.shape[1]])
    bits = (cells * image.size > image.sum(dtype=np.int64) * sizes).ravel()
    return np.packbits(bits).tobytes().hex().ljust(16, "0")


PAGE = "page INT, width INT, height INT, channels INT, bits INT, compression INT, predictor INT, tiled BOOLEAN, hash STRING, samples BINARY"


_PAGES = T.StructType([T.StructField("tiff_pages", T.ArrayType(columns_of(PAGE))), T.StructField("tiff_error", T.StringType())])


def decode_files(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds tiff_pages (an array of page structs) and tiff_error to every row.

    A null content, or bytes that cannot be read, give an empty array and a message in tiff_error; the pages
    before a broken one are not returned. Columns that bear these two names are replaced. Memory is bounded
    by the largest single file and its pages, whose sizes must be in keeping with the file's."""
    names = [c for c in df.columns if c not in _PAGES.names]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(content)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in batch.columns]
                data, pages, error = values[at], [], None
                try:
                    for n, p in enumerate(read_tiff(data or b"")):
                        pages.append({"page": n, "hash": tile_hash(p), **p})
                except TiffError as e:
                    pages, error = [], str(e)
                yield (*values, pages, error), len(data or b"") + 200 + sum(len(p["samples"]) for p in pages)

    return map_rows(df, rows, T.StructType([*df.schema.fields, *_PAGES.fields]))


def tiff_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per page of the files in a binary column, with the input's other columns; an unreadable file gives one row with a null page and tiff_error.

    Input columns that bear the name of a page's field are replaced; the column of the files goes."""
    fields = columns_of(PAGE).names
    files = decode_files(df, content)
    kept = [F.col(f"`{c}`") for c in files.columns if c not in {content, "tiff_pages", *fields}]
    return files.select(*kept, F.explode_outer("tiff_pages").alias("tiff_page")).select("*", *[F.col("tiff_page").getField(c).alias(c) for c in fields]).drop("tiff_page")


def text_tiffs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A TIFF for every text (null: empty): its UTF-8 bytes, padded with blanks to a positive multiple of ROW_BYTES, as samples."""

    def rows(batches):
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                data = payload_tiff(raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES))
                yield (key.as_py(), len(raw), data), len(data)

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), rows, "doc_id LONG, n_bytes LONG, content BINARY")


def text_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a TIFF, reads the pages back and returns digests of what was read.

    Null and empty texts are 192 blanks; equal texts give equal values; every input row gives a row."""
    pages = F.col("tiff_pages")
    # Bytes are joined as strings, which Spark takes as they are.
    whole = F.when(F.size(pages) == 1, pages[0]["samples"]).otherwise(F.array_join(F.transform(pages, lambda p: p["samples"].cast("string")), "").cast("binary"))
    feature = F.concat_ws(":", F.size(pages).cast("string"), F.concat_ws("x", pages[0]["width"], pages[0]["channels"]), pages[0]["compression"].cast("string"), F.array_join(F.transform(pages, lambda p: p["hash"]), ""))
    files = text_tiffs(docs).withColumns({"media_bytes": F.octet_length("content").cast("long"), "media_sha256": F.sha2("content", 256)})
    read = decode_files(files).select("doc_id", "n_bytes", "media_bytes", "media_sha256", whole.alias("payload"), feature.alias("feature"))
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
