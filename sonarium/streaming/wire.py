"""The feed's binary form: MessagePack maps whose keys are the first letters of the fields' names."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sized(n: int, small: int, most: int, wide: tuple[tuple[int, str], ...]) -> bytes:
    """A size: in the first byte up to `most`, else in the narrowest field that holds it."""
    if n <= most:
        return bytes((small | n,))
    for code, kind in wide:
        if n < 1 << (8 * struct.calcsize(kind)):
            return bytes((code,)) + struct.pack(kind, n)
    raise ValueError(f"{n} is too large")


def pack(value: object) -> bytes:
    """A value of maps, lists, texts, bytes, whole numbers, truth values and None."""
    match value:
        case None:
            return b"\xc0"
        case bool():
            return b"\xc3" if value else b"\xc2"
        case int():
            if value < 0:
                if value >= -32:
                    return struct.pack(">b", value)
                for code, kind in ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q")):
                    if value >= -(1 << (8 * struct.calcsize(kind) - 1)):
                        return bytes((code,)) + struct.pack(kind, value)
            return _sized(value, 0, 127, ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")))
        case str():
            raw = value.encode()
            return _sized(len(raw), 0xA0, 31, ((0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I"))) + raw
        case bytes():
            return _sized(len(value), 0, -1, ((0xC4, ">B"), (0xC5, ">H"), (0xC6, ">I"))) + value
        case dict():
            return _sized(len(value), 0x80, 15, ((0xDE, ">H"), (0xDF, ">I"))) + b"".join(pack(k) + pack(v) for k, v in value.items())
        case list() | tuple():
            return _sized(len(value), 0x90, 15, ((0xDC, ">H"), (0xDD, ">I"))) + b"".join(map(pack, value))
    raise TypeError(f"{type(value)} has no binary form")


def insert_change(id_: int, terms: Iterable[int]) -> dict:
    return {"i": {"i": id_, "h": list(terms)}}


def delete_change(id_: int) -> dict:
    return {"d": {"i": id_}}


def page_bytes(entries: Iterable[tuple[int, int, list[int]]], retry_after_ms: int) -> bytes:
    """One answer of the feed: entries of position, fingerprint id and terms."""
    return pack({"e": [{"i": place, "c": insert_change(id_, terms)} for place, id_, terms in entries], "r": retry_after_ms})


def index_feed_bytes(ops: Iterable[tuple[int, str, str]], retry_after_ms: int) -> bytes:
    """Changes to the set of indexes; kinds are numbers on the wire."""
    kinds = {"create": 0, "delete": 1}
    return pack({"o": [{"p": place, "k": kinds[kind], "i": name} for place, kind, name in ops], "r": retry_after_ms})


def bootstrap_bytes(parts: Iterable[object]) -> Iterable[bytes]:
    """A bootstrap stream (see feed.bootstrap_stream): a header with the position, then lists of changes, an empty one at the end."""
    for part in parts:
        yield pack({"p": part} if isinstance(part, int) else [insert_change(id_, terms) for id_, terms in part])


def insert_bytes(id_: Column, terms: Column) -> Column:
    """The binary form of an insert, made on the executors; null for null terms."""

    def run(ids: pa.Array, lists: pa.Array) -> pa.Array:
        pairs = zip(ids.to_pylist(), lists.to_pylist(), strict=True)
        return pa.array([None if i is None or t is None else pack(insert_change(i, t)) for i, t in pairs], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(id_, terms)
