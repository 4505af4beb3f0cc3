"""WARC archives: writing, reading, and assembly of transactions into one nested row per capture.

A capture is a response or revisit record (or a resource), with the request and metadata records that are
tied to it through WARC-Concurrent-To, in either direction and over one record in between.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import checkpointed, partitions, scratch, written

VERSION = b"WARC/1.1"
ARCHIVE_BYTES = 4 << 20
#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 100
#: Revisits up to this many are broadcast to the writers, where no page repeats; else pages are dealt by id.
SMALL = 100_000
#: Fixed value of the format: the profile of a revisit record of an identical payload.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = "archive_id STRING, record_id STRING, record_type STRING, concurrent_to ARRAY<STRING>, target_uri STRING, date STRING, refers_to STRING, declared_digest STRING, http_length LONG, block_length LONG, payload_bytes LONG, payload_digest STRING, fields STRING, payload BINARY, error STRING"


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: " + DATE.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers if v]
    lines.append(b"Content-Length: %d" % len(block))
    # Small records need no large tables, which take longer to clear than the record to pack.
    pack = zlib.compressobj(1, zlib.DEFLATED, 31, 4 if len(block) < 512 else 6 if len(block) < 1 << 16 else 8)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def members(data: bytes) -> Iterator[bytes]:
    """Uncompressed records of an archive; an archive that isn't compressed comes in one piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        # Fed piece by piece: what follows a member is copied back, and must be little.
        unpack, parts, size = zlib.decompressobj(31), [], 2048
        while not unpack.eof and at < len(view):
            fed = view[at : at + size]
            parts.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
            size = min(2 * size, 1 << 20)
        if not unpack.eof:
            raise ValueError("a gzip member is cut short")
        yield b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers (names in lower case) and block of each record."""
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if not part.startswith(b"WARC/", at) or end < 0:
                raise ValueError(f"no record at byte {at}")
            headers = []
            for line in part[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and headers:  # a folded header
                    headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
                else:
                    name, _, value = line.partition(":")
                    headers.append((name.strip().lower(), value.strip()))
            size = int(dict(headers).get("content-length", "0"))
            block = part[end + 4 : end + 4 + size]
            if len(block) < size:
                raise ValueError(f"the record at byte {at} is cut short")
            yield headers, block
            at = end + 4 + size
            while part[at : at + 2] == b"\r\n":
                at += 2


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, body = block.partition(b"\r\n\r\n")
    return (head, body) if mark and head.startswith(b"HTTP/") else (b"", block)


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_archives(archives: DataFrame, content: str = "content", archive_id: str = "archive_id") -> DataFrame:
    """One row per record of the archives in a binary column. An archive that breaks off gives the records before that, then a row with error. Null and empty archives give no rows."""

    def rows(batches):
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for headers, block in parse_records(value.as_py() or b""):
                        h = dict(headers)
                        kind = h.get("warc-type", "")
                        http, payload = _split_http(block) if kind in ("response", "revisit") else (b"", block)
                        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        fields = payload.decode("utf-8", "replace") if kind in ("metadata", "warcinfo") else None
                        links = [_bare(v) for k, v in headers if k == "warc-concurrent-to"]
                        yield (key, _bare(h.get("warc-record-id")), kind, links, h.get("warc-target-uri"), h.get("warc-date"), _bare(h.get("warc-refers-to")), h.get("warc-payload-digest"), int(size[1]) if size else None, len(block), len(payload), hashlib.sha256(payload).hexdigest(), fields, payload, None), len(payload) + 400
                except (ValueError, zlib.error) as e:
                    yield (key, None, None, [], *[None] * 10, str(e)), 200

    return map_rows(archives.select(F.col(archive_id).cast("string"), F.col(content).cast("binary")), rows, RECORD)


CAPTURES, OTHERS = ("response", "revisit", "resource"), ("request", "metadata")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, record_type, target_uri, date, the capture's own record, and the requests and metadata tied to it (arrays, by record id).

    Requests and metadata that lead to no capture are left to orphan_records(). Repeated record ids give repeated rows.
    The joins carry what the input's columns hold; leave out payload where it isn't wanted. The input is read several times."""
    whole = F.struct(*[F.col(c) for c in records.columns])
    captures = records.where(F.col("record_type").isin(*CAPTURES)).select(F.col("record_id").alias("capture_id"), whole.alias("record"))
    others = records.where(F.col("record_type").isin(*OTHERS))
    ids = captures.select("capture_id").distinct()
    # Records that name a capture go straight to it: one exchange serves the join and the grouping.
    tied = others.select(F.explode(F.array_distinct("concurrent_to")).alias("capture_id"), "record_type", whole.alias("other")).join(ids, "capture_id", "left_semi")
    indirect = _indirect(records)
    if not indirect.isEmpty():
        more = others.join(indirect, "record_id").select("capture_id", "record_type", whole.alias("other"))
        tied = tied.unionByName(more)
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    by_type = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.col("other"))), by_id)
    grouped = tied.groupBy("capture_id").agg(by_type("request").alias("requests"), by_type("metadata").alias("metadata"))
    joined = captures.join(grouped, "capture_id", "left")
    return joined.select("capture_id", "record.record_type", "record.target_uri", "record.date", "record", "requests", "metadata")


def _direct(records: DataFrame) -> DataFrame:
    """record_id and capture_id of requests and metadata that name a capture."""
    ids = records.where(F.col("record_type").isin(*CAPTURES)).select(F.col("record_id").alias("capture_id")).distinct()
    links = records.where(F.col("record_type").isin(*OTHERS)).select("record_id", F.explode("concurrent_to").alias("capture_id"))
    return links.join(ids, "capture_id", "left_semi").select("record_id", "capture_id").distinct()


def _indirect(records: DataFrame) -> DataFrame:
    """record_id and capture_id of requests and metadata that a capture names, and of those tied to one over another record, where they do not name it themselves."""
    captures = records.where(F.col("record_type").isin(*CAPTURES))
    named = captures.where(F.size("concurrent_to") > 0).select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id"))
    # Only links whose target is no capture are followed; there are few, or none.
    links = records.where(F.col("record_type").isin(*OTHERS)).select("record_id", F.explode("concurrent_to").alias("target"))
    loose = links.join(captures.select(F.col("record_id").alias("target")), "target", "left_anti")
    if named.isEmpty() and loose.isEmpty():
        return named
    direct = _direct(records)
    near = direct.unionByName(named).select(F.col("record_id").alias("target"), "capture_id")
    far = loose.join(near, "target").select("record_id", "capture_id")
    return named.unionByName(far).join(direct, ["record_id", "capture_id"], "left_anti").distinct()


def orphan_records(records: DataFrame) -> DataFrame:
    """Requests and metadata that lead to no capture."""
    tied = _direct(records).unionByName(_indirect(records)).select("record_id")
    return records.where(F.col("record_type").isin(*OTHERS)).join(tied, "record_id", "left_anti")


def page_urn(page_id: int | None, digest: str, nth: int, kind: str) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}:{digest[:16]}:{nth}:{kind}"


def write_archives(pages: DataFrame) -> DataFrame:
    """archive_id and content (gzip members) from page_id, url, payload, digest and refers_to (a page id: the page revisits that one).

    Every page gives a request, a response or revisit, and a metadata record that names the page. Rows with
    one page id must lie in one partition, where those of one payload are numbered."""

    def clean(url: str | None) -> str:
        return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")

    def rows(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        task, n, seen, parts, size = context.partitionId() if context else 0, 0, Counter(), [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                nth = seen[page_id, digest[:16]]
                seen[page_id, digest[:16]] += 1
                url = clean(url)
                kind = "response" if refers_to is None else "revisit"
                capture = page_urn(page_id, digest, nth, kind)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                tie = [("WARC-Target-URI", url), ("WARC-Concurrent-To", f"<{capture}>")]
                own = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if refers_to is not None:
                    own += [("WARC-Refers-To", f"<{page_urn(refers_to, digest, 0, 'response')}>"), ("WARC-Profile", IDENTICAL)]
                if not parts:
                    parts.append(record("warcinfo", f"urn:archive:{task}:{n}", b"software: sonarium\r\nformat: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")]))
                parts.append(record("request", page_urn(page_id, digest, nth, "request"), b"GET " + url.encode() + b" HTTP/1.1\r\n\r\n", [*tie, ("Content-Type", "application/http; msgtype=request")]))
                parts.append(record(kind, capture, head + payload if refers_to is None else head, own))
                parts.append(record("metadata", page_urn(page_id, digest, nth, "metadata"), b"page-id: %b\r\n" % (b"" if page_id is None else str(page_id).encode()), [*tie, ("Content-Type", "application/warc-fields")]))
                size += sum(map(len, parts[-3:]))
                if size >= ARCHIVE_BYTES:
                    yield (f"{task}-{n}", b"".join(parts)), size
                    n, parts, size = n + 1, [], 0
        if parts:
            yield (f"{task}-{n}", b"".join(parts)), size

    return map_rows(pages.select("page_id", "url", "payload", "digest", "refers_to"), rows, "archive_id STRING, content BINARY")


def page_transactions(pages: DataFrame) -> DataFrame:
    """Writes an archive record per page into the shared folder, reads the archives back and returns a row per page.

    A null html is empty. Among equal payloads of at least REVISIT_BYTES bytes those with the smallest
    page_id are responses, the others revisits of it; a null page_id is never the smallest, unless all are
    null. Rows that repeat both page_id and payload are told apart by number, and all returned."""
    with scratch(pages.sparkSession):
        records = written(_page_records(pages), "records", outlive=True)
    page_id = F.regexp_extract(F.col("metadata")[0]["fields"], r"page-id: (-?\d+)", 1)
    revisit = F.col("record_type") == "revisit"
    refers_to = F.regexp_extract("record.refers_to", r"^urn:page:(-?\d+):", 1)
    return assemble(records).select(
        F.when(page_id != "", page_id.cast("long")).alias("page_id"),
        F.when(revisit, F.col("record.http_length")).otherwise(F.col("record.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("record.declared_digest", "^sha256:", "")).otherwise(F.col("record.payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, refers_to.cast("long")).alias("refers_to"),
    )


def _page_records(pages: DataFrame) -> DataFrame:
    """The records of the archives that the pages were written to, without payloads."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    # Digests are made once, and kept: three plans below read them.
    slim = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")), "digests")
    first = slim.where((F.col("size") >= REVISIT_BYTES)).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    later = slim.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.coalesce("page_id", F.lit(-(2**63))).alias("key"), "digest", F.col("first").alias("refers_to")).distinct()
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("key", F.coalesce("page_id", F.lit(-(2**63))))
    later = checkpointed(later)
    repeats = slim.groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    if later.limit(SMALL + 1).count() <= SMALL and repeats.isEmpty():
        told = keyed.withColumn("digest", F.sha2("payload", 256)).join(F.broadcast(later), ["key", "digest"], "left")
    else:
        told = keyed.repartition(partitions(spark), "key").withColumn("digest", F.sha2("payload", 256)).join(later, ["key", "digest"], "left")
    archives = written(write_archives(told), "archives")
    capture = F.col("record_type").isin(*CAPTURES)
    return read_archives(archives).where(F.col("record_type") != "warcinfo").select("record_id", "record_type", "concurrent_to", "target_uri", "date", "refers_to", "declared_digest", "http_length", "payload_bytes", F.when(capture, F.col("payload_digest")).alias("payload_digest"), "fields")


#: The same rows from the pages themselves, for DuckDB.
PAGES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
