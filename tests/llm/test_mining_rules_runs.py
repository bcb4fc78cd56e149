"""Hard negatives, quality rules and periodic runs against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives, periodic_runs, quality_rules, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def floor256(x):
    return math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256


def brute_negatives(rows, anchors, positives=5, negatives=3):
    usable = [(i, l, [floor256(x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, l, v in sorted((r for r in usable if r[0] in anchors), key=lambda r: (r[0], r[1], r[2])):
        asked.setdefault(i, (l, v))
    out = []
    for i, (l, v) in asked.items():
        scored = [(-sum(a * b for a, b in zip(v, w)), j, k) for j, k, w in usable if j != i and len(w) == len(v)]
        for s, j, _ in sorted((x for x in scored if x[2] == l), key=lambda x: x[:2])[:positives]:
            fits = sorted(x[:2] for x in scored if x[2] != l and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
            out += [(i, j, n, k, clip(-s), clip(-t)) for n, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.select(*names).collect())


VECTOR_ROWS = "vec_id long, embedding array<double>, label int, id string, score int, g int, t int, v int, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2, 3, 4, 5) for i, l, v in rows], VECTOR_ROWS)


@pytest.fixture
def small_groups(monkeypatch):
    for name, value in {"ROW_COMPONENTS": 300, "ANCHOR_COMPONENTS": 100, "MIN_GROUPS": 3, "TILE_ROWS": 8, "TILE_ANCHORS": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)


def test_negatives_of_odd_vectors(spark, small_groups):
    chance = random.Random(3)
    rows = [(i, i % 3, [chance.choice([0.5, 0.25, 1.0, -0.1, 0.7]) for _ in range(4)]) for i in range(60)]  # many ties
    rows += [(100 + i, i % 2, [2.0**41, 1e300 * (i + 1), float(i), 0.3]) for i in range(6)]
    rows += [(200 + i, 1, [2.0**41 + i, 0.0, 1.0, 2.0]) for i in range(4)]
    rows += [(300, 0, None), (301, None, [1.0] * 4), (None, 1, [1.0] * 4), (302, 1, [1.0, None, 1.0, 1.0])]
    rows += [(303, 1, [1.0, float("nan"), 1.0, 1.0]), (304, 1, [float("inf")] * 4)]
    rows += [(310 + i, i % 2, []) for i in range(4)] + [(320 + i, i % 2, [1.0, 2.0]) for i in range(6)]
    rows += [(5, 2, rows[5][2])] * 3 + [(7, 0, [9.0, 9.0, 9.0, 9.0]), (-4, 1, rows[4][2])]
    anchors = {5, 7, 10, 20, 101, 103, 201, 310, 320, 321, -4, 300, 303}
    every = frame(spark, rows)
    got = mined(hard_negatives.hard_negatives(every, every.filter(every.vec_id.isin(list(anchors)))))
    assert got == brute_negatives(rows, anchors)
    assert {r[0] for r in got} >= {5, 7, 101, 310}
    assert mined(hard_negatives.hard_negatives(every.limit(0), every)) == []
    assert mined(hard_negatives.hard_negatives(every, every.limit(0))) == []


@pytest.mark.parametrize("length", [3, 16, 37])
def test_negatives_of_clustered_vectors(spark, small_groups, length):
    chance = np.random.default_rng(length)
    middles = chance.normal(size=(4, length))
    rows = [(i, int(chance.integers(3)), (middles[i % 4] + 0.2 * chance.normal(size=length)).tolist()) for i in range(150)]
    anchors = set(range(0, 150, 10))
    every = frame(spark, rows)
    assert mined(hard_negatives.hard_negatives(every, every.filter("vec_id % 10 = 0"))) == brute_negatives(rows, anchors)


def test_bounds_hold_and_spare_pairs():
    chance = np.random.default_rng(1)
    raw = np.repeat(chance.normal(size=(200, 4)), 16, axis=1) + 0.05 * chance.normal(size=(200, 64))
    rows = hard_negatives.Vectors(np.arange(200), np.zeros(200, int), raw, 256)
    exact, every = rows.numbers @ rows.numbers.T, np.arange(200)
    widths = []
    for size in hard_negatives.SEGMENTS:
        low, high = hard_negatives.bounds(rows, rows, size, every, every)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[0] > widths[1] > widths[2]
    least = np.partition(exact, -5, axis=1)[:, -5]
    a, r, left = hard_negatives.surviving(rows, rows, np.ones((200, 200), bool), least, np.full(200, np.inf))
    assert left.sum() < 0.1 * exact.size
    assert {(x, y) for x, y in zip(*np.nonzero(exact >= least[:, None]))} <= {(a[i], r[j]) for i, j in zip(*np.nonzero(left))}


def brute_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i = i + 1 if i == start else i
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    chance = random.Random(seed)
    for _ in range(n):
        kinds = chance.randint(1, 4)
        w = [chance.randrange(kinds) for _ in range(chance.randint(0, 60))]
        if w and chance.random() < 0.6:
            a, p = chance.randrange(len(w)), chance.randint(1, 9)
            w[a : a + 60] = [w[min(a + i % p, len(w) - 1)] for i in range(60)]
        yield w


@pytest.mark.parametrize("least,times", [(6, 4), (6, 3), (7, 2)])
def test_runs_match_brute_force(least, times):
    texts = list(sequences(least, 400))
    assert periodic_runs.runs(texts, least, times) == [brute_runs(w, least, times) for w in texts]


def test_long_runs_take_time_in_proportion():
    assert periodic_runs.runs([[i % 70_000 for i in range(300_000)], ["x"] * 200_000]) == [[(0, 300_000, 70_000)], [(0, 200_000, 1)]]


def runs_row(doc_id, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(kept)))


def test_runs_of_odd_rows(spark, odd, monkeypatch):
    repeats = [(i, " ".join(map(str, w)).replace(" ", "\t\x0b", 1), None, None, i) + (1,) * 11 for i, w in enumerate(sequences(9, 60))]
    frame = odd.union(spark.createDataFrame([(*r[:5], 1, "x", 1, 1, 1, 1, 1, "f", 1, 1, 1) for r in repeats], odd.schema))
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame)
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    long = {r.doc_id for r in frame.collect() if len(r.text or "") > 10_000}
    short = sorted((runs_row(r.doc_id, r.text) for r in frame.collect() if len(r.text or "") <= 10_000), key=key)
    assert sorted((r for r in got if r[0] not in long), key=key) == [r for r in short if r[0] not in long]
    # the long text is one sentence of ten words over and over, wherever its words are repeated from
    assert [r[1] for r in got if r[0] in long and r[4] == 10] and all(r[1] >= 1 for r in got if r[0] in long)
    assert sum(r[1] for r in got) > 20
    named = periodic_runs.find_runs(odd, out="score")
    assert named.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0


def rules_row(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {x for x in windows if windows.count(x) > 1}
    inside = {i + k for i, x in enumerate(windows) if x in many for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    doubled = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(inside)


def test_statistics_match_brute_force(spark, odd):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += [r.text for r in odd.collect() if len(r.text or "") < 10_000]
    texts += ["a b c d e f g h " * 3, "x\n\n x\nx\r\nx\x0b\nx", "a b c d e f g h i a b c d e f g h", "　 \xa0 é é"]
    base, features = quality_rules.statistics([t or "" for t in texts])
    assert [tuple(b) for b in base.tolist()] == [rules_row(t) for t in texts]
    assert np.isfinite(features).all()


def test_paths_match_a_walk_through_the_trees():
    chance = np.random.default_rng(5)
    rows, others = chance.normal(size=(300, 4)), chance.normal(size=(20, 4)) + 6
    forest = quality_rules.Forest(rows, others, trees=7, tree_rows=64)

    def path(tree, x):
        feature, value, left, right, length = tree
        node = 0
        while feature[node] >= 0:
            node = left[node] if x[feature[node]] <= value[node] else right[node]
        return length[node]

    assert np.allclose(forest.paths(others), [np.mean([path(t, x) for t in forest.trees]) for x in others])
    # at a leaf: its depth and the expected rest for its rows, so that counts weighed with paths are a tree's own
    assert forest.score(others).min() > forest.score(rows).max()
    assert np.allclose(quality_rules.expected_path([1, 2, 3]), [0, 1, 2 * (np.log(2) + np.euler_gamma) - 4 / 3])


def test_rules_find_bad_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    method = got[~got.base_failed]
    assert (~method[method.quality == 0].kept).mean() > 0.9
    assert method[method.quality == 1].kept.mean() > 0.99
    assert (~got.kept[got.base_failed]).all()


def test_rules_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(10)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(odd, labels)
    found = quality_rules.apply_rules(odd, model, out="SCORE")
    assert found.columns == [c for c in odd.columns if c != "score"] + ["SCORE"]
    got = found.collect()
    assert len(got) == odd.count() and not any(r.SCORE.kept for r in got if not r.text)
    assert all((r.SCORE.n_words, r.SCORE.n_repeat_words) == rules_row(r.text)[::4] for r in got if len(r.text or "") < 10_000)
    empty = quality_rules.train(odd, labels.limit(0))
    assert empty.threshold == math.inf and quality_rules.train(odd.limit(0), labels).threshold == math.inf
    assert quality_rules.apply_rules(odd.limit(0), empty).count() == 0
    long = [r for r in quality_rules.apply_rules(odd, empty).collect() if len(r.text or "") > 10_000]
    assert not any(r.rules.kept for r in long)  # one sentence over and over


def plain_text(i, bad=False):
    words = [f"word{(i * 7 + k * (1 + i % 5)) % 61}" + "x" * ((i + k) % 6) for k in range(24 + i % 9)]
    return " ".join(w.upper() + "!!??" if bad else w for w in words)


def test_rules_learn_from_all_labelled_rows(spark):
    """Bad labels behind the first 6,000 keys by hash: a model of these keys alone finds nothing odd."""
    order = [r.k for r in spark.range(7_000).toDF("k").orderBy(F.xxhash64(F.lit(42), "k"), "k").collect()]
    rows = [(k, plain_text(k, place >= 6_900), int(place < 6_900)) for place, k in enumerate(order)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_rules.train(frame, frame)
    got = quality_rules.apply_rules(frame, model).select("quality", "rules.odd").collect()
    assert sum(r.odd for r in got if r.quality == 0) > 90
    assert sum(r.odd for r in got if r.quality == 1) <= 0.005 * 6_900
    # all good rows are counted, as in a forest grown of them in one place
    features = quality_rules.statistics([t for _, t, _ in rows])[1]
    good = np.array([y for *_, y in rows]) == 1
    whole = quality_rules.Forest(features[good], features[~good])
    assert model.forest.size == 6_900
    assert all(np.array_equal(a, b) for t, u in zip(model.forest.trees, whole.trees) for a, b in zip(t, u))


def test_threshold_of_rows_left_out_matches_brute_force(spark):
    chance = np.random.default_rng(8)
    width = len(quality_rules.FEATURES)
    features = np.concatenate([chance.normal(size=(90, width)), chance.normal(size=(30, width)) * 1.5 + 1])
    good = np.arange(120) < 90
    rows = spark.createDataFrame(list(zip(features.tolist(), good.tolist())), "features array<double>, good boolean").repartition(5)
    forest, left_out = quality_rules.forests(rows)
    grown = quality_rules.random_trees(features.min(0), features.max(0), 90)
    paths = forest.paths(features)
    for i in range(90):  # a good row's path in the forest of the others
        rest = features[:90][np.arange(90) != i]
        paths[i] = quality_rules.Forest.counted(grown, quality_rules.ended(grown, rest), 90).paths(features[i : i + 1])[0]
    assert np.array_equal(left_out.paths(features[:90]), paths[:90])
    for good_lost in (0.0, 0.05, 0.3):
        tried = [(np.mean(paths[~good] < p) - np.mean(paths[good] < p), p) for p in set(paths) if np.mean(paths[good] < p) <= good_lost]
        gain, best = max((round(g, 12), p) for g, p in tried)
        want = forest.scored((best + max(paths[paths < best])) / 2) if gain > 0 else math.inf
        assert quality_rules.best_threshold(rows, forest, left_out, good_lost) == want
    assert quality_rules.best_threshold(rows.filter("good"), forest, left_out) == math.inf


def test_labelled_keys_count_once(spark):
    docs = [(i, plain_text(i)) for i in range(6)] + [(1, plain_text(1)), (2, plain_text(9)), (None, plain_text(3)), (7, "few words"), (8, None)]
    labels = [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (3, 0), (4, None), (5, 0), (7, 1), (8, 0), (9, 1), (None, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rules.labelled(docs, labels, "text", "doc_id", "quality").collect()
    least = docs.filter("doc_id = 2").orderBy(F.xxhash64("text")).head().text
    texts = [(plain_text(0), True), (plain_text(1), True), (least, True), (plain_text(3), False), (plain_text(5), False)]
    assert sorted((r.features, r.good) for r in got) == sorted((quality_rules.statistics([t])[1][0].tolist(), y) for t, y in texts)
