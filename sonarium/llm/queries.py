"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonarium.llm import chat, decontam, minhash, mixing, packing, quality, repair, suffix, tiff, tokens, topk, trie, warc


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, at the same place on all executors; SONARIUM_TOKENIZERS may name another folder."""
    folder = os.environ.get("SONARIUM_TOKENIZERS")
    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_digests(table(spark, sf_dir, "documents"))


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One and a half times the input's tokens, at 0.9 of the entropy of equal sources, no source more than three times."""
    mixed = mixing.mix_stream(table(spark, sf_dir, "documents"), target_entropy=0.9, max_repeats=3.0, passes=1.5)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_exponent", "mix_entropy", "mix_rule", "mix_epoch", "mix_block", "mix_order")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(table(spark, sf_dir, "conversations"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_transactions(table(spark, sf_dir, "pages"))


def op11_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


_ALL = (
    op1_tiff, op2_pairwise_quality, op3_temperature_mix, op4_chat_format, op5_exact_top_k, op6_suffix_dedup, op7_cost_packing, op8_trie_token_counts, op9_probminhash,
    op10_warc_transactions, op11_cost_layers, op12_fm_decontamination, op13_prefix_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


#: DuckDB SQL of the queries that SQL can say; the others are tested against brute force.
SQL: dict[str, str] = {
    "op5_exact_top_k": topk.TOP_K_SQL,
    "op10_warc_transactions": warc.PAGES_SQL,
    "op12_fm_decontamination": decontam.CONTAMINATION_SQL,
    "op13_prefix_trie": trie.TRIE_SQL,
}
