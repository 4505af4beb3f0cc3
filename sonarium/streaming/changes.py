"""Row changes of a table as a source, messages that keep the latest change of a key, and an index that follows them.

Changes come as lines of JSON, as logical decoding writes them (format version 2): action I, U or D, columns with
names and values, and the identity of the row that an update or delete means. Lines lie in files whose names
give their order; what was read is remembered by the stream's checkpoint, so a line may come twice, never not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import fingerprint as fp

_COLUMN = "array<struct<name: string, type: string, value: string>>"
_LINE = f"action string, schema string, `table` string, lsn string, xid bigint, columns {_COLUMN}, identity {_COLUMN}"
#: The attribute of an index that holds the last batch it took.
SEQUENCE = "stream_sequence"


class BrokenChange(ValueError):
    """A line lacks the row's id, or an insert or update its hashes."""


def position(lsn: Column) -> Column:
    """A log position such as 16/B374D848 as a number."""
    return F.conv(F.concat(F.lpad(F.substring_index(lsn, "/", 1), 8, "0"), F.lpad(F.substring_index(lsn, "/", -1), 8, "0")), 16, 10).cast("decimal(20,0)")


def decoded(lines: DataFrame, table: str = "fingerprint", schema: str = "public", hashes: str = "fingerprint") -> DataFrame:
    """lsn, xid, action, id, hashes and broken of the lines (value) that change rows of one table; hashes are null for deletes.

    Other actions and tables are left out. broken says that a line lacks what its action needs; such lines must
    not be passed over, see checked()."""
    x = lines.select(F.from_json("value", _LINE).alias("x")).select("x.*")
    mine = x.where(F.col("action").isin("I", "U", "D") & (F.col("schema") == schema) & (F.col("table") == table))
    value = lambda where, name: F.element_at(F.filter(where, lambda c: c["name"] == name), 1)["value"]
    pick = lambda where, name: F.when(F.exists(where, lambda c: c["name"] == name), value(where, name))
    id_ = F.when(F.col("action") == "I", pick("columns", "id")).otherwise(pick("identity", "id")).cast("long")
    held = F.when(F.col("action") != "D", fp.parse_array(pick("columns", hashes)))
    rows = mine.select(position(F.col("lsn")).alias("lsn"), "xid", "action", id_.alias("id"), held.alias("hashes"))
    return rows.withColumn("broken", F.col("id").isNull() | ((F.col("action") != "D") & F.col("hashes").isNull()))


def checked(changes: DataFrame) -> DataFrame:
    """Changes without the mark; BrokenChange if any bears it."""
    bad = changes.where("broken").limit(1).collect()
    if bad:
        raise BrokenChange(f"the change at {bad[0].lsn} lacks its id or hashes")
    return changes.drop("broken")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each id, as a message store keeps that has one message a subject."""
    rest = [c for c in changes.columns if c != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*rest), "lsn").alias("r")).select("id", "r.*")


def message(changes: DataFrame) -> DataFrame:
    """subject and body of changes: what is sent for each, with the query terms and bit vote of its hashes."""
    kind = F.element_at(F.create_map(*map(F.lit, ("I", "insert", "U", "update", "D", "delete"))), F.col("action"))
    body = F.to_json(F.struct("id", kind.alias("kind"), fp.extract_query(F.col("hashes")).alias("query"), fp.simhash("hashes").alias("simhash")))
    return changes.select(F.concat(F.lit("changes."), F.col("id").cast("string")).alias("subject"), "lsn", body.alias("body"))


def kept_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """subject, lsn and body: of all messages the newest of each subject."""
    return old.unionByName(new).groupBy("subject").agg(F.max_by(F.struct("lsn", "body"), "lsn").alias("m")).select("subject", "m.*")


def initial_load(snapshot: DataFrame) -> DataFrame:
    """All rows (id, hashes) of a snapshot as inserts at position 0: a snapshot is a folder that nobody changes any more."""
    return snapshot.select(F.lit(0).cast("decimal(20,0)").alias("lsn"), F.lit(0).cast("long").alias("xid"), F.lit("I").alias("action"), "id", "hashes")


def follow(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None], files_per_batch: int = 1) -> None:
    """Reads all lines that are there now, in the order of their files, and hands each batch's latest changes to apply, with the batch's number.

    A batch is acknowledged once apply returns. After a failure it comes again, with the same number: apply
    must then leave out a number that it has seen, as an index does that stores it (see apply_to_index())."""

    def batch(lines: DataFrame, number: int) -> None:
        apply(latest_changes(checked(decoded(lines))), number)

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_to_index(index, changes: DataFrame, number: int):
    """The index (see search.TermIndex) after a batch; unchanged if it holds this batch already. The number is stored in the same step."""
    if index.attribute(SEQUENCE, -1) >= number:
        return index
    return index.updated(changes.select("id", F.when(F.col("action") != "D", F.col("hashes")).alias("hashes")), {SEQUENCE: number})
