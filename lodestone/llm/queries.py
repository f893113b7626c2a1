"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, embed_dedup, html_extract, language, lexical, line_dedup, packing, pii, quality, sharding, simhash, spelling


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard(_documents(spark, folder).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, folder))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    out = html_extract.extract(pages.select("page_id", "url", "html"), html_extract.train(pages)).drop("html")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_documents(spark, folder).select("doc_id", "text")).drop("text")
    kinds = F.transform("pii", lambda s: s["kind"])
    number = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(pii.KINDS[:4]))
    return found.select("doc_id", *number, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, folder).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    out = language.identify(docs.select("doc_id", language.held_out().alias("held_out"), "text"), language.train(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, folder))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_documents(spark, folder))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    out = chat.conversations(chat.as_messages(rows.unionByName(extra)))
    return out.mapInArrow(chat.digest, chat.DIGEST).select(
        F.split("path", ":")[0].try_cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_documents(spark, folder))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_sharding, op3_bpe, op4_html_extraction, op5_pii, op6_packing, op7_line_dedup, op8_language_id, op9_simhash_near_dedup, op10_quality_rules, op11_lexical_search, op12_chat_formatting, op13_spelling_variants)}
SQL: dict[str, str] = {"op1_embedding_near_dedup": embed_dedup.SQL, "op7_line_dedup": line_dedup.SQL, "op10_quality_rules": quality.SQL, "op11_lexical_search": lexical.SQL, "op12_chat_formatting": chat.SQL, "op13_spelling_variants": spelling.SQL}
