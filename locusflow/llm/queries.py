"""The operators as driver queries: one opN_<name> each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed public vocabularies are; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents")).drop("row_number")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.fim import digests

    return digests(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusflow.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from locusflow.llm import chat, fim, trie

    return {"op5_chat_format": chat.SQL, "op11_fill_in_middle": fim.SQL, "op13_conversation_trie": trie.SQL}
