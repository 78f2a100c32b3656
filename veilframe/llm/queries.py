"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, language_id, line_dedup, quality, simhash, sql, token_counts, token_store, toxicity, url_rules
from .common import scratch_path, table
from .sampling import held_out

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 1


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER, END_ID)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT_SCORE).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), removed_into="n_removed")
    return cut_out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


#: The rules of the contract.
URL_RULES = [
    url_rules.Rule("net", "/", "block"),
    url_rules.Rule("example.net", "/en/", "allow"),
    url_rules.Rule("example.com", "/de/", "block"),
    url_rules.Rule("org", "/fr/", "allow"),
]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    f = q["features"]
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *(f[k].alias(k) for k in base), q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), F.array_join(q["failed"], ",").alias("failed"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    v = F.col("verdict")
    items = F.sha2(F.array_join(v["items"], ","), 256)
    return judged.select("doc_id", v["n_words"].alias("n_words"), v["n_hit"].alias("n_hit"), F.size(v["items"]).cast("long").alias("n_items"), items.alias("items_sha256"), v["contaminated"].alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_rules": op3_url_rules,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": sql.LINE_DEDUP,
    "op3_url_rules": sql.URL_RULES,
    "op4_quality": sql.QUALITY,
    "op10_decontamination": sql.DECONTAMINATION,
}
