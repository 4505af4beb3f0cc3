"""Accounts and applications: rows with new ids, edits, keys, and the tables that are tied to them."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
import string
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.operators.state import numbered

#: Days for which a demonstration key is looked for, from today on.
KEY_DAYS = 7
LETTERS = string.ascii_letters + string.digits


def new_key(length: int = 10) -> str:
    """A random key of letters and digits."""
    return "".join(secrets.choice(LETTERS) for _ in range(length))


def demo_key(secret: str, day: date | None = None) -> str:
    """The key of a day: 64 bits of a keyed digest of the day's number, its last letter but one an A."""
    message = f"{(day or date.today()).toordinal():x}".encode()
    digest = hmac.new(f"{secret}:demo-client-api-key".encode(), message, hashlib.md5).digest()
    text = base64.urlsafe_b64encode(digest[:8]).decode().rstrip("=")
    return text[:-2] + "A" + text[-1]


def is_demo_key(secret: str, key: str, today: date | None = None) -> bool:
    """Whether a key is that of today or of one of the six days to come; a past day's is not taken."""
    start = today or date.today()
    return len(key) == 11 and key[-2] == "A" and any(hmac.compare_digest(key, demo_key(secret, start + timedelta(days=i))) for i in range(KEY_DAYS))


def edited(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """rows with the columns that a change of their key names (the change's other columns): null there means that the value stays."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in names])
    held = rows.join(new, key, "left")
    return held.withColumns({c: F.coalesce(f"new_{c}", c) for c in names}).select(rows.columns)


def touched(rows: DataFrame, key: str, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """rows of which those with one of the ids have a new value in one column."""
    hit = ids.select(key).distinct().withColumn("hit_", F.lit(True))
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("hit_"), value).otherwise(F.col(column))).select(rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows but those whose key another table has, as when pending ones are done."""
    return rows.join(gone.select(key), key, "left_anti")


def inserted(rows: DataFrame, new: DataFrame, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with new rows, which get the next ids, and these rows with their ids.

    Ids ascend in the order of the rows' columns; see state.numbered(). Rows that are alike all get an id."""
    names = [c for c in rows.columns if c != id_column]
    top = rows.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("top")).scalar()
    given = numbered(new.select(names), names).select((F.col("n") + top).cast(rows.schema[id_column].dataType).alias(id_column), *names)
    return rows.unionByName(given.select(rows.columns)), given


def usage(applications: DataFrame, lookups: DataFrame) -> DataFrame:
    """Applications (id, name) with their lookups (application, hits, misses), summed; those without any have zeros."""
    sums = lookups.groupBy(F.col("application").alias("id")).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return applications.select("id", "name").join(sums, "id", "left").select("id", "name", zero("hits"), zero("misses"))


def by_login(accounts: DataFrame, logins: DataFrame) -> DataFrame:
    """Accounts (id, name) with the logins (account_id, login) that lead to them."""
    return accounts.join(logins.select(F.col("account_id").alias("id"), "login"), "id").select("id", "name", "login")
