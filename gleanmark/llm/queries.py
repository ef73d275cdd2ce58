"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.llm import bitslice, crosstok, langid, lines, mixing, neardup, packing, passages, periodic, simhash, sstable, warc, weakrules
from gleanmark.llm.common import WORD, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20, 64)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = sstable.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)
    return sstable.read(spark, folder, manifest, with_ids=False)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), 1.5, 2).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(documents(spark, sf_dir), (85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removals(documents(spark, sf_dir)).select("doc_id", "line_no")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weakrules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, model).withColumn("held_out", langid.held_out())


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(documents(spark, sf_dir), size=3, radius=2)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    told = crosstok.align(documents(spark, sf_dir), a, b, shown=digest)
    return told.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("groups", "groups_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the tail of every tenth text, by the crc32 of its doc_id, made of a few of its own words over and
    over. A null doc_id has no crc32, and its text stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    sized = split.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    told = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.get("w", F.col("a") + i % F.col("p")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), tail)
    return told.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = periodic.repeats(with_planted_runs(documents(spark, sf_dir)), least=6, times=4)
    # Runs are in order of start and period, so that the first of equals stays.
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), more)
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    rows = told.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_bit_sliced_top_k, op3_warc_archive, op4_token_shards, op5_source_mixing, op6_substring_dedup, op7_minhash_near_dedup, op8_line_dedup, op9_quality_rules, op10_language_id, op11_simhash_near_dedup, op12_cross_tokenizer_alignment, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op2_bit_sliced_top_k": bitslice.ORACLE, "op3_warc_archive": warc.ORACLE, "op5_source_mixing": mixing.ORACLE, "op7_minhash_near_dedup": neardup.ORACLE, "op8_line_dedup": lines.ORACLE}
