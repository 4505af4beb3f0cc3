"""Readers and writers of tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.functions.text import jsonp


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; only where Spark runs in this process, and none is named, in the temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Scratch:
    """Tables on the way to a result, in the shared folder: each row is made once, survives its executor, and goes at the block's end.

    What leaves the block must not read them, but for tables kept with outlive."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()

    def keep(self, df: DataFrame, name: str = "step", outlive: bool = False) -> DataFrame:
        path = shared_folder(self.spark, name)
        df.write.parquet(path)
        if not outlive:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew where its scan has fewer splits than there are cores, for heavy work on each row; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Databases:
    """Tables of several databases by name: folders of Parquet, or JDBC addresses. Reading may go to a replica."""

    def __init__(self, spark: SparkSession, writable: dict[str, str], replicas: dict[str, str] | None = None):
        self.spark, self.writable, self.replicas = spark, writable, replicas or {}

    def where(self, database: str, read_only: bool) -> str:
        return self.replicas.get(database, self.writable[database]) if read_only else self.writable[database]

    def scan(self, database: str, name: str, read_only: bool = True, key: str | None = None, parts: int = 16) -> DataFrame:
        """A table. Over JDBC, with a numeric key, it is read in ranges of the key, by as many tasks as there are parts."""
        place = self.where(database, read_only)
        if not place.startswith("jdbc:"):
            return self.spark.read.parquet(f"{place}/{name}.parquet")
        reader = self.spark.read.format("jdbc").option("url", place)
        if key is None:
            return reader.option("dbtable", name).load()
        ends = reader.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").load().first()
        reader = self.spark.read.format("jdbc").option("url", place).option("dbtable", name)
        if ends[0] is None:
            return reader.load()
        return reader.option("partitionColumn", key).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1] + 1)).option("numPartitions", str(parts)).load()


#: Fixed values of the text format of table dumps: what stands for null, and what a backslash and a letter stand for.
DUMP_NULL = "\\N"
DUMP_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def dump_line(schema: T.StructType) -> Column:
    """A row as a line of a dump: columns between tabs, with backslashes and control characters escaped, so that every text comes back."""

    def field(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            text = F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "NULL"), F.lit("}"))
        elif isinstance(f.dataType, T.BinaryType):
            text = F.concat(F.lit("\\x"), F.lower(F.hex(c)))
        elif isinstance(f.dataType, T.BooleanType):
            text = F.when(c, "t").when(~c, "f")
        else:
            text = c.cast("string")
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for sign, written in DUMP_ESCAPES.items():
            text = F.replace(text, F.lit(sign), F.lit(written))
        return F.coalesce(text, F.lit(DUMP_NULL))

    return F.array_join(F.array(*map(field, schema.fields)), "\t")


def dump(df: DataFrame, path: str) -> None:
    """The rows as a text dump: a folder of part files, a line a row."""
    df.select(dump_line(df.schema).alias("value")).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a text dump."""
    fields = T.StructType.fromDDL(schema).fields

    def field(i: int, f: T.StructField) -> Column:
        raw = F.get("parts", F.lit(i))
        # Pairs of backslashes are cut out first: what is between them has single ones only.
        pieces = F.split(raw, r"\\\\", -1)
        pieces = F.transform(pieces, lambda x: reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), DUMP_ESCAPES.items(), x))
        text = F.when(raw != DUMP_NULL, F.array_join(pieces, "\\"))
        if isinstance(f.dataType, T.ArrayType):
            return F.from_json(F.translate(text, "{}", "[]"), f.dataType)
        if isinstance(f.dataType, T.BinaryType):
            return F.unhex(F.substring(text, 3, 2**31 - 1))
        return text.cast(f.dataType)

    lines = spark.read.option("lineSep", "\n").text(path).select(F.split("value", "\t", -1).alias("parts"))
    return lines.select(*[field(i, f).alias(f.name) for i, f in enumerate(fields)])


def export(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """A dump of each table, or of a query, under its name."""
    for name, df in tables.items():
        dump(df, f"{folder}/{name}")
    return sorted(tables)


def as_json(df: DataFrame, callback: str | None = None) -> DataFrame:
    """One text column: each row as JSON with sorted names, or as a call."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.select((F.to_json(row) if callback is None else jsonp(F.lit(callback), row)).alias("value"))


def _one(name: str) -> str:
    """The singular of a list's name."""
    return name[:-3] + "y" if name.endswith("ies") else name.removesuffix("s")


def _escaped(value: Column) -> Column:
    text = value.cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def xml(value: Column, name: str, kind: T.DataType) -> Column:
    """A value as an XML element: fields by name, those called @k as attributes, list items under the singular of the list's name; nulls are left out."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        marks = [F.concat(F.lit(f' {f.name[1:]}="'), _escaped(value.getField(f.name)), F.lit('"')) for f in fields if f.name.startswith("@")]
        body = [xml(value.getField(f.name), f.name, f.dataType) for f in fields if not f.name.startswith("@")]
        inside = F.concat(F.lit(f"<{name}"), *[F.coalesce(m, F.lit("")) for m in marks], F.lit(">"), *body, F.lit(f"</{name}>"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: xml(v, _one(name), kind.elementType))
        inside = F.concat(F.lit(f"<{name}>"), F.array_join(items, ""), F.lit(f"</{name}>"))
    else:
        inside = F.concat(F.lit(f"<{name}>"), _escaped(value), F.lit(f"</{name}>"))
    return F.when(value.isNotNull(), inside).otherwise("")


def as_xml(df: DataFrame, root: str = "response") -> DataFrame:
    """One text column: each row as an XML document."""
    return df.select(xml(F.struct(*df.columns), root, df.schema).alias("value"))


def hourly_sample(spark: SparkSession, first: str, last: str, seed: int = 1) -> DataFrame:
    """Made-up hits and misses for each hour between two times."""
    hours = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)), F.expr("interval 1 hour"))).alias("hour"))
    return hours.select("hour", (F.rand(seed) * 1000).cast("long").alias("hits"), (F.rand(seed + 1) * 100).cast("long").alias("misses"))


def noisy(df: DataFrame, share: float = 0.1, seed: int = 1) -> DataFrame:
    """Probes: in a share of the hashes one bit is turned over, and the length moves by up to eight."""
    mix = lambda i, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i, F.col("id")), F.lit(10**6))
    hash_ = lambda x, i: F.when(mix(i, 0) < int(share * 10**6), x.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.pmod(mix(i, 1), F.lit(32)).cast("int")))).otherwise(x)
    return df.withColumns({"hashes": F.transform("hashes", hash_), "length": F.col("length") + F.pmod(mix(F.lit(-1), 2), F.lit(17)) - 8})
