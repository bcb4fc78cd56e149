"""The sample of the classifiers, and models without evidence."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing, toxicity


def words_of(i, n):
    return " ".join(f"plain{(i * 7 + k) % 50} thing{k % 9}" + ("." if k % 5 == 4 else "") for k in range(n))


def test_a_long_text_keeps_no_other_out_of_the_sample(spark):
    rows = [(i, ("gruffo. " if i % 2 else "") + words_of(i, 20), i % 2) for i in range(200)]
    order = [r[0] for r in spark.createDataFrame(rows, "k long, t string, y int").orderBy(F.xxhash64(F.lit(42), "k")).collect()]
    for long_text in (words_of(1, 3000), words_of(1, 800)):  # more than the bound, and more than the bound leaves
        some = [(i, long_text if i == order[0] else t, y) for i, t, y in rows]
        frame = spark.createDataFrame(some, "doc_id long, text string, y int")
        texts, y = toxicity.bounded_sample(frame, frame.selectExpr("doc_id AS k", "y"), "text", "doc_id", 1000, 40_000, long_chars=5_000)
        assert len(y) >= 100 and min(Counter(y.tolist()).values()) >= 40
        assert long_text not in list(texts)


def test_toxicity_without_evidence_keeps_documents(spark):
    rows = [(i, "gruffo words in a row. " * (1 + i % 40), i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = frame.select("doc_id", "toxic")
    nulls = known.selectExpr("doc_id", "CAST(NULL AS int) AS toxic")
    for labels in (known.limit(0), nulls, known.filter(toxicity.held_out(known.doc_id))):
        scores = [r.score for r in toxicity.score(frame, toxicity.train(frame, labels)).select("toxicity.score").collect()]
        assert len(scores) == 60 and set(scores) == {0.0}
    blank = frame.selectExpr("doc_id", "' ' AS text", "1 AS toxic")
    assert toxicity.score(frame, toxicity.train(blank, blank)).filter("toxicity.score >= 0.5").count() == 0


def test_clean_texts_score_low_at_any_length(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    clean = "\n".join(r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").orderBy("doc_id").collect())
    scores = [model.document((clean * 13)[:n])[0] for n in (10_000, 100_000, 1_000_000, 10_000_000)]
    assert max(scores) < 0.1
    toxic = [model.document(r.text)[0] for r in docs.join(labels.filter("toxic = 1"), "doc_id").collect()]
    assert sum(s >= 0.5 for s in toxic) > 0.7 * len(toxic)


def test_score_is_a_noisy_or(spark):
    model = toxicity.Model(-4.0, {})
    model.word = lambda w: {"awful": 5.0, "odd": 1.0}.get(w, 0.0)
    sigma = lambda z: 1 / (1 + math.exp(-z))
    text = "This is an awful awful line. Here is one odd line more. And a plain line of words. Such an awful odd thing here."
    adds = [(1 - sigma(1.0)) / (1 - sigma(-4.0)), (1 - sigma(2.0)) / (1 - sigma(-4.0))]
    score, spans = model.document(text)
    assert score == pytest.approx(1 - (1 - sigma(-4.0)) * adds[0] * adds[1])
    assert [next(w for w in text[s["start"] : s["end"]].split() if w == "awful") for s in spans] == ["awful", "awful"]
    assert model.document("plain words only here now")[0] == pytest.approx(sigma(-4.0))


def test_small_sources_take_their_share(spark):
    """1,500 sources of one text of 20 words: each comes near its target, none with a target is left out."""
    rows = [(i, f"s{i:05d}", " ".join(f"w{k}" for k in range(20))) for i in range(1500)] + [(9999, "none", "")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sum(r.taken for r in got) == pytest.approx(30_000, rel=0.01)
    assert all(abs(r.taken - r.target) <= 1 for r in got)
    assert {r.target > 0 for r in got if r["size"]} == {True} and {round(r.target) for r in got if r["size"]} == {10, 20, 30}
