"""The queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import bpe, chat, collocations, crf, decontaminate, html, infill, langmodel, oracles, passages, rules, sharding, simhash, warc
from heronlake.llm.common import crc_mod, table

#: Production parameters of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def hex_sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def token_digest(docs: DataFrame) -> DataFrame:
    both = bpe.round_trip(docs, vocabulary_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), hex_sha256("decoded").alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~rules.passes("base")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & rules.passes("v1")).alias("kept"), "failed")


def op5_langmodel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = langmodel.scores(docs, langmodel.fit(docs.where(crc_mod("doc_id", 7) != 2)))
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def quality_model(docs: DataFrame, labels: DataFrame) -> crf.Model:
    return crf.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = crf.scores(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.examples(rows))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.examples(table(spark, sf_dir, "documents")).withColumn("restored", infill.restored())
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hex_sha256("output").alias("output_sha256"), hex_sha256("restored").alias("restored_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", hex_sha256("kept").alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_bpe, op3_warc, op4_rules, op5_langmodel, op6_html, op7_quality, op8_chat, op9_simhash, op10_decontamination, op11_infill, op12_collocations, op13_passages, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL (models, XXH64, tokenizer, markup) and are tested by brute force."""
    return {"op3_warc": oracles.OP3, "op4_rules": oracles.OP4, "op8_chat": oracles.OP8, "op10_decontamination": oracles.OP10, "op11_infill": oracles.OP11, "op12_collocations": oracles.OP12, "op13_passages": oracles.OP13}
