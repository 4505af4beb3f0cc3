"""Scalar functions on metadata, ids and keys, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarium.functions.fingerprint import uuid5

#: The namespace of metadata ids, their fields in order, the largest track and disc numbers.
META_NAMESPACE = "3b3bd2285d2c11eab49860f67731bf41"
META_FIELDS = ("track", "artist", "album", "album_artist", "track_no", "disc_no", "year")
LARGEST_NUMBER = 10000
#: Fixed value: what counts as an e-mail address.
EMAIL = r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,4}\z"


def fix_text(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[\s\x00\x1c-\x1f]+", " ")


def fix_number(value: Column) -> Column:
    return F.when(value <= LARGEST_NUMBER, value)


def meta_id(**fields: Column) -> Column:
    """Content id of metadata: compact JSON of the fields that are neither null, empty texts nor the number zero."""

    def given(k: str) -> Column:
        # The text "0" is a title like any other; only as a number is it nothing.
        empty = F.when(F.typeof(fields[k]) == "string", fields[k].cast("string") == "").otherwise(fields[k].cast("string").isin("0", "0.0"))
        return F.when(~empty, fields[k]).alias(k)

    present = [given(k) for k in META_FIELDS if k in fields]
    text = F.to_json(F.struct(*present)) if present else F.lit("{}")
    return uuid5(META_NAMESPACE, F.encode(text, "utf-8"))


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"), F.lit(False))


def is_foreign_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-z]+:.+$"), F.lit(False))


def singular(value: Column) -> Column:
    """One of a list by its name; null for a name that is no plural."""
    return F.when(value.endswith("ies"), F.regexp_replace(value, r"ies\z", "y")).when(value.endswith("s"), F.regexp_replace(value, r"s\z", ""))


def counter_key(*parts: Column) -> Column:
    """Parts joined by colons, with colons, blanks and the like in them quoted; blanks as %20, slashes as they are."""
    quoted = [F.replace(F.replace(F.url_encode(p.cast("string")), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")) for p in parts]
    return F.concat_ws(":", *quoted)


def counter_part(key: Column, index: int) -> Column:
    return F.url_decode(F.get(F.split(key, ":"), index))


def lock_id(name: Column) -> Column:
    return F.crc32(name).bitwiseAND(F.lit(0x7FFFFFFF))


def shard(key: Column, shards: int = 256) -> Column:
    return F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(shards)))), 2, "0")


def jsonp(callback: Column, value: Column, default: str = "callback") -> Column:
    """A JSON value as a call of the named function, or of a default one where the name is null or not well formed."""
    part = r"[$A-Za-z_][0-9A-Za-z_]*"  # a dollar sign may only begin a name
    name = F.when(callback.rlike(rf"^{part}(\.{part})*\z"), callback).otherwise(default)
    return F.concat(name, F.lit("("), F.to_json(value), F.lit(")"))


def is_email(value: Column) -> Column:
    """An address as sign-up forms take it."""
    return F.coalesce(value.rlike(EMAIL), F.lit(False))


def is_url(value: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(value, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(value, F.lit("HOST"))) > 0), F.lit(False))


def foreign_parts(value: Column) -> Column:
    """Vendor and name: cut at the first colon only."""
    parts = F.split(value, ":", 2)
    return F.struct(F.get(parts, 0).alias("vendor"), F.get(parts, 1).alias("name"))


def partition_name(prefix: str, day: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(F.trunc(day, "MM"), "yyyyMM"))


def grams(name: Column, size: int = 4) -> Column:
    """The distinct runs of some characters of a name in lower case without blanks; none where it is shorter."""
    plain = F.regexp_replace(F.lower(name), r"\s+", "")
    starts = F.when(F.length(plain) >= size, F.sequence(F.lit(1), F.length(plain) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(plain, i, size)))
