"""A corpus pipeline: each stage takes what the one before kept, written as Parquet and read again.

Stages take documents (doc_id, text, source and any other columns) and return their columns; the last
one adds ``shard`` and ``slot``, which replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, mixing, sharding, simhash, toxicity
from cohortlens.llm.common import fresh, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half; the model learns from their labels."""
    [found] = fresh(docs.columns, "found")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out=found)
    return scored.filter(F.col(found)["score"] < 0.5).drop(found)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    [found] = fresh(docs.columns, "found")
    marked = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), out=found)
    return marked.filter(F.col(found)["n_hit"] == 0).drop(found)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    results = ("size", "source_size", "target", "taken")
    aside = dict(zip(docs.columns, fresh([*docs.columns, *results], *[f"own_{c}" for c in docs.columns])))
    aside = {c: n for c, n in aside.items() if c.lower() in results}
    renamed = docs.withColumnsRenamed(aside)
    copies = mixing.mixed_copies(mixing.mix(renamed), renamed.columns)
    return copies.withColumnsRenamed({n: c for c, n in aside.items()})


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; every shard matches the mixture."""
    return sharding.interleave(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Learnt scores, fingerprints and seeded hashes have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
