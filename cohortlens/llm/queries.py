"""Registered queries of the package: each applies its operator to its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, hard_negatives, mixing, periodic_runs, pii, quality, quality_rules, sharding, simhash, substring_dedup, topk,
    toxicity, warc,
)
from .common import shared_folder, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), out="hit")
    return found.select(
        "doc_id", "hit.n_words", "hit.n_hit",
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        (F.col("hit.n_hit") > 0).alias("contaminated"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return sharding.interleave(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="found").select("doc_id", "found")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "found.score",
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.col("found.sentences").alias("sentences"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="score").select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter(f"vec_id % {topk.EVERY} = 0"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, carry=["doc_id"])
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.dedup_units(
        docs, kind="block", least_words=1, least_stretch=substring_dedup.LEAST_STRETCH
    )
    return found.select("doc_id", F.size("removed").alias("n_removed"), "removed", "kept_text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, rows.filter("vec_id % 50 = 0"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    found = quality_rules.apply_rules(docs, model)
    return found.select("doc_id", *[f"rules.{c}" for c in (*quality_rules.BASE, "base_failed", "kept", "anomaly")])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(partly_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("periodic.strongest")
    return found.select(
        "doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


def partly_periodic(docs: DataFrame) -> DataFrame:
    """Texts as the contract of op13 reads them: where h = crc32(doc_id) is divisible by 10, words repeat from one on.

    Word a + i, i >= 0, is word a + i % p, with g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8);
    the words are joined by one space. A null key leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    chosen = docs.withColumns({"h": h, "w": F.when(h % 10 == 0, words)}).withColumn("n", F.size("w").cast("long"))
    g = F.floor(F.col("h") / 10)
    at = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    at = at.withColumn("p", period.cast("int")).withColumn("times", F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    start = F.col("a").cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", start + 1, F.col("p")), F.col("times")))
    whole = F.slice(F.concat(F.slice("w", 1, start), again), 1, F.col("n").cast("int"))
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}
