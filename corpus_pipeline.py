"""The corpus pipeline: good documents, one of each near-duplicate group, without repeated passages, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import minhash, mixing, packing, quality, suffix
from sonarium.llm.queries import table, tokenizer_file
from sonarium.llm.storage import delete, scratch, stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learnt from the labels of these documents, accepts.

    Null and empty texts are judged like texts without words; without any label all documents stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; of all texts without words one stays."""
    return minhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with what is left of its text, which may be nothing; a null text comes out empty."""
    kept = suffix.remove_repeats(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("kept_row").getField(c).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of sources that gain weight up to twice, one row each time.

    The rows of a document that comes twice are alike; packing tells them apart by row_id."""
    mixed = mixing.mix_stream(docs, target_entropy=0.98, max_repeats=1.5, budget=None)
    return mixed.select([F.col(f"`{c}`") for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), cache_words=300_000, with_ids=True)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The stages are iterative, or work on hashes and models that SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Each stage's table goes once the next one is written; the last, which the result reads, stays in the shared folder."""
    docs, held = table(spark, sf_dir, "documents"), None
    *before, (_, last) = STAGES
    for name, stage in before:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), name)
        if held:
            delete(spark, held)
        held = path
    return last(spark, docs, sf_dir)
