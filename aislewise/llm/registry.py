"""The ``opN_*`` queries: each operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.llm import bpe_pairs, byte_cnn, chat_windows, edit_decontam, merkle, minhash_dups, pii_disclosure, quality_rules, suffix_dups, token_counts, toxic_mil, turn_repair, warc
from aislewise.llm.common import default_tokenizer, table
from aislewise.llm.oracles import ORACLES  # noqa: F401


def op1_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in documents; documents without one have no row."""
    found = edit_decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op2_suffix_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dups.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), default_tokenizer("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dups.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.predict_languages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bpe_pairs.encode_texts(docs, default_tokenizer("word_bpe_49k.json"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.withColumnRenamed("id", "doc_id")


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_disclosure.personal_spans(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxic_mil.predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


#: Conversation -7: what stands in its texts are control strings of chat templates.
_CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _CONTROL_TEXT), (-7, 1, "assistant", _CONTROL_TEXT)], turns.schema)
    windows = chat_windows.format_windows(turns.unionByName(extra), chat_windows.piece_counter(default_tokenizer("piece_bpe_32k.model")))
    return chat_windows.read_back(windows).drop("n_windows").withColumnRenamed("id", "conv_id")


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = warc.round_trip(pages)
    return out.selectExpr(f"cast(key AS {kind}) AS page_id", "payload_bytes", "payload_digest", "record_type", f"cast(refers_to AS {kind}) AS refers_to")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turn_repair.damaged(turns)
    audits = turn_repair.audit_conversations(rows, ids=turns.select("conv_id"))
    found = turn_repair.digests(turn_repair.repaired_turns(rows, audits)).withColumnRenamed("id", "other")
    out = audits.join(found, audits["id"].eqNullSafe(found["other"]), "left").drop("other")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).withColumnRenamed("id", "conv_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = merkle.leaf([F.replace(docs[c], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in fields])
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(docs, fields, changed=F.when(chosen, cut).otherwise(merkle.leaf([docs[c] for c in fields])))
    out = out.withColumn("folded_root", merkle.folded())
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_decontamination": op1_edit_decontamination,
    "op2_suffix_lpf_dedup": op2_suffix_lpf_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_minhash_near_dups": op4_minhash_near_dups,
    "op5_byte_cnn_language": op5_byte_cnn_language,
    "op6_bpe_pair_index": op6_bpe_pair_index,
    "op7_pii_disclosure": op7_pii_disclosure,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_toxicity_mil": op9_toxicity_mil,
    "op10_chat_windows": op10_chat_windows,
    "op11_warc_archives": op11_warc_archives,
    "op12_turn_repair": op12_turn_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}
