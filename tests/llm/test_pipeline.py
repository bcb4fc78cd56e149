"""The pipeline's stages on the small tables and on odd rows."""

from collections import Counter

import corpus_pipeline
import pytest
from test_operators import bench_words, brute_components, plain_print

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("frame", ["given", "odd"])
def test_stages_keep_columns_and_decide(spark, odd, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if frame == "given" else odd
    bench = [bench_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[a : a + 10]) for w in bench for a in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name)
        rows, kept = docs.collect(), after.collect()
        if name == "near_duplicates":
            groups = brute_components([r.doc_id for r in rows], [plain_print(r.text) for r in rows])
            assert Counter(r.doc_id for r in kept) == Counter(set(groups))
        if name == "decontamination":
            clean = [r for r in rows if not any(tuple(w[a : a + 10]) in windows for w in [bench_words(r.text)] for a in range(len(w) - 9))]
            assert Counter(clean) == Counter(kept)
        if name == "sharding":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in kept)
        else:
            assert after.columns == docs.columns
        docs = after
    assert docs.count() > 0
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_toxic_documents_go(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, SF).collect()}
    rows = [(r.toxic, r.doc_id in kept) for r in labels.collect()]
    assert sum(not k for y, k in rows if y == 1) >= 0.7 * sum(y == 1 for y, _ in rows)
    assert sum(k for y, k in rows if y == 0) >= 0.95 * sum(y == 0 for y, _ in rows)
