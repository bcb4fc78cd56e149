"""Each operator against a brute-force version, and on odd rows."""

import gzip
import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, mixing, pii, quality, sharding, simhash, substring_dedup, topk, toxicity, warc

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def bench_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(A_Z))


def brute_hits(texts, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows[tuple(w[a : a + k])].add(i)
    out = []
    for t in texts:
        w, hit, found = bench_words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= {str(i) for i in own if i is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def hits(df):
    return [(r["hit"]["n_words"], r["hit"]["n_hit"], r["hit"]["items"]) for r in df.orderBy("doc_id").collect()]


def test_decontamination_matches_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = hits(decontamination.decontaminate(docs, bench, out="hit"))
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert got == brute_hits(texts, [(r.item_id, r.text) for r in bench.collect()])
    assert any(n for _, n, _ in got)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_decontamination_of_odd_rows(spark, odd, block_bytes):
    items = [(1, "a very LONG text that goes on some words of a"), (2, "one two"), (3, "x"), (4, None), (5, ""), (None, "end"), (2, "one two"), (6, "字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = hits(decontamination.decontaminate(frame, bench, out="hit", block_bytes=block_bytes))
    assert got == brute_hits([r.text for r in frame.orderBy("doc_id").collect()], items)
    assert decontamination.decontaminate(odd, bench, out="score").columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert decontamination.decontaminate(odd, bench.limit(0)).filter("decontamination.n_hit > 0").count() == 0
    assert decontamination.decontaminate(odd.limit(0), bench).count() == 0


def test_shards_match_the_mixture(docs, odd):
    got = sharding.interleave(docs, shards=8).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for source, n in Counter(r.source for r in got).items():
        own = Counter(r.shard for r in got if r.source == source)
        assert all(abs(own[s] - n / 8) <= 2 for s in sizes), source
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs.repartition(5), shards=8).collect()} == {
        (r.doc_id, r.shard, r.slot) for r in got
    }
    few = sharding.interleave(odd, shards=40)
    assert ids(few) == ids(odd) and few.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert max(Counter(r.shard for r in few.collect()).values()) == 1
    assert sharding.interleave(odd.limit(0)).count() == 0


def test_small_sources_spread_over_the_parts(spark):
    tail = spark.range(4000).selectExpr("id AS doc_id", "concat('site', id div 2) AS source")
    ranks = tail.selectExpr("source", "1L + doc_id % 2 AS r", "2L AS n")
    place = sharding.fractional_rank(F.col("r"), F.col("n"), F.col("source"), 42)
    found = ranks.select(place.alias("x")).agg(F.min("x"), F.max("x"), F.countDistinct(F.floor(F.col("x") * 1000))).first()
    assert found[0] >= 0 and found[1] < 1 and found[2] > 800
    got = sharding.interleave(tail, shards=8, parts=16).collect()
    assert sorted(Counter(r.shard for r in got).items()) == [(s, 500) for s in range(8)]
    by_source = Counter((r.source, r.shard) for r in got)
    assert max(by_source.values()) == 1


def water(sizes, weights):
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[x] for x in sizes if x not in capped) for s in sizes if s not in capped}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in sizes}
        capped |= over


@pytest.mark.parametrize("scale", ["given", "odd"])
def test_mix_nears_its_targets(docs, odd, scale):
    frame = docs if scale == "given" else odd
    got = mixing.mix(frame).collect()
    assert len(got) == frame.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
    assert all(abs(taken[s] - wanted[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    again = mixing.mix(frame.repartition(7)).select("doc_id", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mixed_copies_keep_rows_without_words(odd):
    kept = mixing.mixed_copies(mixing.mix(odd), ["doc_id", "text"])
    assert kept.filter("text = '' OR text IS NULL").count() == 3


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: all(int(x) <= 255 for x in g.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda g, d: 12 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 9 <= len(d) <= 15),
}


def brute_spans(t):
    found = []
    for at, (kind, (pattern, ok)) in enumerate(BASE.items()):
        found += [(m.start(), at, kind, m.end()) for m in re.finditer(pattern, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


HARD = [
    "a@b.co@c.de x_y@z.w_q@r.st", "@@a@b a@b. a@b.c.", "1.2.3.4.5 01.002.255.0 256.1.1.1 1..2.3.4.5 999991.1.1.1", "4111-1111 1111 1111 1",
    "+1 2 +49 (30) 1234-5678. +12345678901234567890", "1 " * 3000, "7" * 5000, "a." * 4000 + "@x", "é😀 mail: ü@x.de ñ a@b.cd",
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE00 3704 0044 0532 0130 00", "ssn 123-45-6789 or 123-45-6789",
]


def test_pii_matches_brute_force(spark, docs, odd):
    hard = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for frame in (docs, odd, hard):
        for r in pii.find_pii(frame).select("text", "pii").collect():
            got = [(x.start, x.kind, x.end) for x in r.pii if x.kind in pii.BASE_KINDS]
            assert got == brute_spans(r.text), r.text[:80]
    extra = pii.find_pii(hard).selectExpr("doc_id", "explode(filter(pii, x -> x.kind IN ('iban', 'ssn'))) AS x").collect()
    assert Counter((r.doc_id, r.x.kind) for r in extra) == {(9, "iban"): 2, (10, "ssn"): 2}
    assert pii.find_pii(odd.limit(0)).count() == 0


def plain_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_Z))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(keys, prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[find(i)].append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_near_duplicates_match_brute_force(request, name):
    frame = request.getfixturevalue(name)
    rows = frame.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    wanted = Counter((r.doc_id, p, c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints)))
    got = simhash.near_duplicates(frame).collect()
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == wanted
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(brute_components([r.doc_id for r in rows], prints)))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_covering_masks_and_tiles(spark):
    masks = simhash.covering_masks()
    chance = np.random.default_rng(1)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in chance.choice(64, 3, replace=False))
        assert any(not m & bits for m in masks)
    base = int(chance.integers(1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in chance.integers(0, 62, (300, 2))} | set(chance.integers(1 << 62, size=50).tolist()))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    stars = simhash.components(simhash.links(frame, tile=16)).collect()
    group = {r.node: r.root for r in stars}
    wanted = brute_components(prints, prints)
    assert [group.get(p, p) for p in prints] == wanted


def test_long_text_is_read_in_pieces(monkeypatch):
    text = "Alpha beta\tgamma delta epsilon zeta " * 50
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_toxicity_learns_and_points(spark, labels, odd):
    texts = [(i, f"A calm line here with number {i}. " + ("You are a gruffo person really. " if i % 4 == 0 else "It is fine today. ") + "The end of it.") for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(frame, known)
    got = toxicity.score(frame, model).orderBy("doc_id").collect()
    assert [int(r.toxicity.score >= 0.5) for r in got] == [int(i % 4 == 0) for i in range(400)]
    assert all("gruffo" in r.text[s.start : s.end] for r in got for s in r.toxicity.sentences)
    scored = toxicity.score(odd, model, out="score").select("doc_id", "score.score").collect()
    assert len(scored) == odd.count() and all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.score(odd.limit(0), model).count() == 0
    nothing = toxicity.train(frame.limit(0), known)
    assert toxicity.score(frame, nothing).count() == 400


def test_quality_learns_junk(docs, labels, odd):
    model = quality.train(docs, labels)
    got = {r.doc_id: r.quality for r in quality.score(docs, model).collect()}
    apart = {r.doc_id: r.quality for r in labels.filter(quality.held_out(labels.doc_id)).collect()}
    assert sum((got[i] >= 0.5) == (y == 1) for i, y in apart.items() if i in got) >= 0.85 * len(apart)
    scores = quality.score(odd, model, out="score").collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(odd, quality.train(docs, labels.limit(0))).count() == odd.count()


def brute_top(rows, queries, k):
    out = {}
    for q, v in queries:
        w = np.floor(64 * np.array(v)).astype(int)
        found = sorted((-int(np.floor(64 * np.array(x)).astype(int) @ w), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 16)
    monkeypatch.setattr(topk, "FAN", 1)
    chance = np.random.default_rng(3)
    rows = [(i, chance.normal(size=4).tolist()) for i in range(90)] + [(200 + i, [0.5] * 4) for i in range(60)] + [(300, [1.0, 2.0])]
    bad = [(400, None), (401, [None, 1.0, 1.0, 1.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (404, []), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in topk.top_k(frame, frame.filter("vec_id % 20 = 0"), k=7, query_block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    wanted = brute_top(rows, [r for r in rows if r[0] % 20 == 0], 7)
    assert got == {q: x for q, x in wanted.items() if x}
    assert topk.top_k(frame.limit(0), frame, k=7).count() == 0 and topk.top_k(frame, frame.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [3, 4096])
def test_top_k_ranks_components_of_any_size_exactly(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE_ROWS", tile)
    monkeypatch.setattr(topk, "TILE_QUERIES", 2)
    monkeypatch.setattr(topk, "FAN", 1)
    big = [2.0**41, -(2.0**41), 2.0**62 + 2.0**11, -(2.0**70), 1e300, -1e300, 1.7e308, 2.0**56, 2.0**57 - 16]
    rows = [(i, [x, 1.0]) for i, x in enumerate(big)] + [(i, [(i % 7) - 3 + 0.3, 0.5]) for i in range(20, 60)]
    rows += [(100, [1e300, 1.0]), (101, [1e300, 1.0 + 2.0**-6]), (102, [2.0**41, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in topk.top_k(frame, frame.filter("vec_id % 3 = 0"), k=9, query_block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    limit = 2**63 - 1
    for q in [i for i in exact if i % 3 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in exact if i != q)[:9]
        assert got[q] == [(i, max(-limit, min(limit, -s))) for s, i in scores], q


PAGES = [(1, "u%\n", "x" * 99), (2, None, "x" * 99), (5, "u", "y" * 100), (4, "u", "y" * 100), (3, "u", None), (None, "u", "y" * 100), (6, "u", "ü漢\r\n\r\nWARC/1.1\r\n" * 20), (7, "u", "")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    found = warc.read_archives(spark, f"{tmp_path}/w")
    assert warc.quarantined(found).count() == 0
    got = {tuple(r) for r in warc.page_records(found).collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = set()
    for i, _, t in PAGES:
        revisit = t is not None and t.startswith("y") and i != 4
        wanted.add((i, len((t or "").encode()), digest(t), "revisit" if revisit else "response", 4 if revisit else None))
    assert got == wanted
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def record(i, n=300):
    body = f"body {i} ".encode() * n
    return warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}")], body)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed):
    parts = [gzip.compress(record(i), mtime=0) if packed else record(i) for i in range(6)]
    starts = np.cumsum([0] + [len(p) for p in parts]).tolist()
    whole = b"".join(parts)
    assert [r[:2] for r in warc.salvage(whole).records] == [(a, b - a) for a, b in zip(starts, starts[1:])]
    hurt = bytearray(whole)
    hurt[starts[2] + len(parts[2]) // 2] ^= 0xFF
    found = warc.salvage(bytes(hurt) + b"junk")
    assert [r[0] for r in found.records] == [s for i, s in enumerate(starts[:-1]) if i != 2]
    assert [g[:2] for g in found.gaps] == [(starts[2], starts[3]), (len(whole), len(whole) + 4)]
    cut = warc.salvage(whole[: starts[3] + 20])
    assert len(cut.records) == 3 and cut.gaps[0][:2] == (starts[3], starts[3] + 20)
    assert warc.salvage(b"").records == [] and warc.salvage(b"\x00" * 9).gaps == [(0, 9, "no version line or header end")]


def test_large_member_ends_with_zero():
    data = b"z" * (1 << 24)
    assert gzip.decompress(warc.member(data) + b"\x00") == data


def plain_words(t):
    return [w.casefold() for w in re.findall(r"\w+", unicodedata.normalize("NFKC", t))]


def plain_units(t, kind):
    """Units in order, found character by character; all of a text lies in a unit or between two."""
    if kind == "line":
        return re.split("(\n)", t)[::2]
    if kind == "paragraph":
        return re.split(r"\n[^\S\n]*\n\s*", t)
    if kind == "sentence":
        return [x for line in t.split("\n") for x in re.split(r"(?<=[.!?:])\s+", line)]
    out, unit = [], ""
    for piece in re.findall(r"\w+|\W+", t):
        if not re.match(r"\w", piece):
            # a run of blanks ends a block if it holds a line end or follows a full stop, mark or colon
            for part in re.findall(r"\s+|\S", piece):
                unit += part
                if part.isspace() and ("\n" in part or unit[: -len(part)][-1:] in (*".!?:",)) and len(re.findall(r"\w+", unit)) >= 4:
                    out.append(unit)
                    unit = ""
            continue
        unit += piece
        if len(piece) >= 9 and len(re.findall(r"\w+", unit)) >= 4:
            out.append(unit)
            unit = ""
    return [*out, unit]


def brute_kept(rows, kind, least, stretch=0):
    seen, out = set(), []
    for _, t in rows:
        at, found = 0, []
        for unit in plain_units(t or "", kind):
            a = t.index(unit, at) if unit else at
            at, words = a + len(unit), plain_words(unit)
            if len(words) >= least:
                found.append((a, at, len(words), tuple(words) in seen))
                seen.add(tuple(words))
        gone = [[x] for x in found if x[3]]
        if stretch:
            gone = [list(g) for again, g in groupby(found, key=lambda x: x[3]) if again]
        spans = [(g[0][0], g[-1][1]) for g in gone if sum(x[2] for x in g) >= stretch]
        edges = [0, *[x for span in spans for x in span], len(t or "")]
        out.append((spans, t if t is None else "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    return out


@pytest.mark.parametrize("kind,least,stretch", [("sentence", 4, 0), ("line", 4, 0), ("paragraph", 4, 0), ("block", 1, 25), ("block", 3, 10)])
def test_dedup_matches_brute_force(docs, kind, least, stretch):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = substring_dedup.dedup_units(docs, kind=kind, least_words=least, least_stretch=stretch).orderBy("doc_id").collect()
    assert [([(x.start, x.end) for x in r.removed], r.kept_text) for r in got] == brute_kept(rows, kind, least, stretch)
    assert any(r.removed for r in got)


def test_passages_are_found_wherever_they_are_joined_in(spark):
    chance = np.random.default_rng(5)
    word = lambda: "".join(chance.choice(list("abcdefghijklmno"), int(chance.integers(2, 12))))
    some = lambda n: " ".join(word() for _ in range(n))
    flowing = some(60)
    short = " ".join(f"{some(5)}." for _ in range(12))
    texts = [f"{some(30)} {x} {some(30)}" for x in (flowing, flowing, short, short)] + [f"{some(40)} the usual line of six words. {some(40)}" for _ in range(5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup_units(frame, kind="block", least_words=1, least_stretch=25).collect()}
    assert sorted(i for i in got if got[i].removed) == [1, 3]
    for i, passage in ((1, flowing), (3, short)):
        (span,) = got[i].removed
        low = texts[i].index(passage)
        assert max(0, min(span.end, low + len(passage)) - max(span.start, low)) > 0.6 * len(passage)
        assert span.start >= low and span.end <= low + len(passage) + 1


def test_a_text_of_very_many_repeats_is_cut_in_one_pass():
    text = "one and the same line comes again\n" * 300_000
    kept, spans = substring_dedup.without_units(text, range(1, 300_000), "line", 6, 0)
    assert len(spans) == 299_999 and kept == "one and the same line comes again" + "\n" * 300_000
    kept, spans = substring_dedup.without_units(text, range(1, 300_000), "block", 1, 25)
    assert len(spans) == 1 and kept == "one and the same line comes again\n"
    for odd in ("\n" * 200_000, "! " * 200_000, "x" * 500_000, "!\n" * 200_000):
        assert sum(1 for _ in substring_dedup.blocks(odd)) == 1


def test_dedup_of_odd_rows(odd):
    got = substring_dedup.dedup_units(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.text and r.text.startswith("Same")]
    assert sorted((r.doc_id, len(r.removed)) for r in same) == [(5, 0), (5, 0), (5, 0), (6, 1)]
    assert all(r.kept_text == r.text for r in got if not r.removed)
    assert substring_dedup.dedup_units(odd.limit(0)).count() == 0
