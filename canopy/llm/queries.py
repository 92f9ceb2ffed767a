"""The subpackage's registered queries, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.llm.oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from canopy.llm.decontam import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_spec())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_spec())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.quality import assess

    return assess(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from canopy.llm.bpe import decode, encode

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        spec = f.read()
    out = decode(encode(table(spark, sf_dir, "documents"), spec), spec)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from canopy.llm.manifest import folded, leaf, manifest

    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = leaf(*values, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", "lang", own.alias("leaf"), F.when(tampered, leaf(*values, lowered)).otherwise(own).alias("claimed"))
    out = folded(manifest(rows), "claimed")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_bpe": op11_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
