"""Helpers for operators that run over Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonarium.llm.storage import bounded_batches

_KINDS = {"LONG": T.LongType, "INT": T.IntegerType, "STRING": T.StringType, "BINARY": T.BinaryType, "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType}


def struct(columns: str) -> T.StructType:
    """A schema of plain columns from "name KIND, ...", without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]()) for name, kind in (c.split() for c in columns.split(", "))])


#: Rows leave Python in batches of about this many payload bytes, so that long texts stay in bounded memory.
FLUSH_BYTES = 4 << 20


def _kept() -> dict[str, object]:
    """What this Python worker keeps from task to task."""
    import sys
    import types

    module = sys.modules.setdefault("sonarium_worker_cache", types.ModuleType("sonarium_worker_cache"))
    return module.__dict__.setdefault("kept", {})


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps over the tasks of one kind that it runs; a task of another kind drops it."""
    held = _kept()
    if name not in held:
        release()
        held[name] = make()
    return held[name]


def release() -> None:
    """Gives back what earlier tasks left in this Python worker: kept objects, and freed memory that the allocators still hold."""
    import ctypes

    _kept().clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


class RowWriter:
    """Collects Python rows and cuts them into Arrow batches of bounded size."""

    def __init__(self, schema: T.StructType, limit: int = FLUSH_BYTES):
        self.schema = to_arrow_schema(schema)
        self.limit = limit
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 64) -> bool:
        self.rows.append(row)
        self.size += size
        return self.size >= self.limit or len(self.rows) >= 20_000

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[tuple, int]]], schema: T.StructType | str, keeps: bool = False) -> DataFrame:
    """mapInArrow over a generator of (row, bytes); the output is cut into batches of bounded size. keeps: the rows use worker_cache()."""
    bounded_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        out = RowWriter(kind)
        for row, size in rows(batches):
            if out.add(row, size):
                yield out.batch()
        if out.rows:
            yield out.batch()

    return df.mapInArrow(run, kind)
