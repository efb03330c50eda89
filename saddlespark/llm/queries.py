"""One query per operator, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, forest, licenses, line_dedup, mixing, ngram_join, packing, pages, phrases, quality, sharding, sql, token_alignment
from .common import table


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every document, the two base rules and the verdict of the table of rules."""
    df = quality.apply_rules(table(spark, sf, "documents"))
    c = F.col("quality.counts")
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    return df.select(
        "doc_id",
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & F.col("quality.kept")).alias("kept"),
    )


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of each document the mix takes, and the budget of its source."""
    return mixing.plan(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every 20th vector."""
    return forest.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    back = chat.read_back(chat.windows(turns.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    light = back.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", told.alias("told"), "learnt").alias("w"))
    whole = light.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws")
    )
    said = F.array_join(F.transform("ws", lambda w: w["told"]), "")
    learnt = F.array_join(F.transform("ws", lambda w: w["learnt"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(table(spark, sf, "documents"))


def op5_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    found = pages.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one, exactly or nearly."""
    kept = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"), F.char_length("text").cast("long").alias("n_chars"), "text")


def op7_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and place of every document; shards hold nearly the same number of bytes."""
    return sharding.shard(table(spark, sf, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Size of every document's set of 4-word shingles and its component of links at Jaccard 0.85."""
    return ngram_join.near_duplicates(table(spark, sf, "documents"), words=4, percent=85)


def op10_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Which window holds which piece of which document."""
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Which row stays for every document, of those whose texts are equal but for the case of A-Z."""
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document, and how common the links are."""
    found = token_alignment.alignment_statistics(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The 2,000 phrases of every language whose words attract each other most, of those with 100 occurrences."""
    return phrases.collocations(table(spark, sf, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL by query; searches, parsers and packers have none and are tested against brute force."""
    return {
        "op1_mix_sources": sql.mix_sources(),
        "op3_chat_format": sql.chat_format(CONTROL),
        "op4_license_scan": sql.license_scan(),
        "op8_quality_rules": sql.quality_rules(),
        "op11_exact_dedup": sql.exact_dedup(),
        "op13_collocations": sql.collocations(),
    }
