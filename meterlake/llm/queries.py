"""The registered corpus queries: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import chat_format, embedding_dedup, filter_audit, fingerprints, lexical_search, license_scan, line_dedup, mixing, near_dedup, packing, resampling, substring_dedup, toxicity, twins
from meterlake.llm._spark import read, shuffle_partitions


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read(spark, sf_dir, "documents"), min(8 * shuffle_partitions(spark), 8192))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(own)))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return sample.select("doc_id", "log_weight", "key", F.lit(True).alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    scored = toxicity.score(docs, model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(line_dedup.page_lines(read(spark, sf_dir, "pages")), "host", "text")  # page_id, host and text alone
    return cut.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, corpus = lexical_search.build_index(read(spark, sf_dir, "documents"))
    return lexical_search.search(index, corpus, read(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_fingerprints, op2_chat_formatting, op3_quality_resampling, op4_toxicity, op5_near_dedup, op6_line_dedup, op7_substring_dedup, op8_embedding_dedup, op9_mixing, op10_packing, op11_lexical_search, op12_filter_audit, op13_license_scan)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": chat_format.ORACLE,
        "op5_near_dedup": twins.NEAR,
        "op6_line_dedup": line_dedup.ORACLE,
        "op7_substring_dedup": twins.REPEATS,
        "op8_embedding_dedup": twins.VECTORS,
        "op9_mixing": mixing.oracle(),
        "op11_lexical_search": lexical_search.oracle(),
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_license_scan": license_scan.oracle(),
    }
