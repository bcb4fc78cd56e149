"""Damage inside gzip members, and the size of archives."""

import gzip
import hashlib

import numpy as np
import pytest

from cohortlens.llm import warc


def record(i, n=300):
    body = f"body {i} ".encode() * n
    return warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}")], body)


def test_salvage_inside_a_member():
    records = [record(i) for i in range(6)]
    starts = np.cumsum([0] + [len(r) for r in records]).tolist()
    hurt = bytearray(b"".join(records))
    hurt[starts[2] + len(records[2]) // 2] ^= 0xFF
    packed = gzip.compress(bytes(hurt), mtime=0)
    found = warc.salvage(packed + gzip.compress(record(7), mtime=0))
    assert [r[3][:6] for r in found.records] == [b"body %d" % i for i in (0, 1, 3, 4, 5, 7)]
    [gap] = found.gaps
    assert gap[:2] == (0, len(packed)) and f"bytes {starts[2]} to {starts[3]}" in gap[2]


@pytest.mark.parametrize("level", [0, 9])
def test_salvage_of_a_damaged_or_cut_off_member(level):
    chance = np.random.default_rng(1)
    blocks = [chance.bytes(30_000) for _ in range(8)]
    digests = [hashlib.sha256(b).hexdigest() for b in blocks]
    whole = gzip.compress(b"".join(warc.record([("WARC-Payload-Digest", f"sha256:{d}")], b) for d, b in zip(digests, blocks)), level, mtime=0)
    cut = warc.salvage(whole[: len(whole) * 3 // 4])
    assert [r[3] for r in cut.records] == blocks[:5] or [r[3] for r in cut.records] == blocks[:6]
    assert [g[:2] for g in cut.gaps] == [(0, len(whole) * 3 // 4)]
    hurt = bytearray(whole)
    hurt[-6] ^= 0xFF  # its check sum
    found = warc.salvage(bytes(hurt) + gzip.compress(record(9), mtime=0))
    assert [r[3] for r in found.records][:8] == blocks and len(found.records) == 9
    assert found.gaps[0][:2] == (0, len(whole))
    plain = gzip.compress(warc.record([], b"x" * 100) + warc.record([], b"y" * 100), level, mtime=0)
    unsure = warc.salvage(plain[:-6] + b"\x00" + plain[-5:])
    assert unsure.gaps[0][0] == 0 and not [r for r in unsure.records if r[0] == 0]
    assert [r[3] for r in warc.salvage(plain[:-4]).records] == [b"x" * 100, b"y" * 100]


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 4000)
    monkeypatch.setattr(warc, "ARCHIVE_BUNDLES", 3)
    chance = np.random.default_rng(2)
    html = [chance.bytes(n).hex() for n in [100] * 60 + [3000] * 20 + [9000] * 3 + [100] * 40]
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    files = list((tmp_path / "w").glob("part-*"))
    largest = max(len(warc.member(t.encode())) for t in html) + 400
    assert len(files) > 5 and max(f.stat().st_size for f in files) <= 3 * max(4000, largest)
    found = warc.read_archives(spark, f"{tmp_path}/w")
    assert warc.quarantined(found).count() == 0
    got = sorted((r.page_id, r.payload_digest) for r in warc.page_records(found).collect())
    assert got == [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(html)]


def test_an_archive_too_large_to_read_costs_no_other(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i) for i in range(30)))
    (tmp_path / "c.warc").write_bytes(record(3) + record(4))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")  # the engine refuses to open larger files
    try:
        found = warc.read_archives(spark, str(tmp_path), largest=5000).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found if r.gap is None) == ["a.warc.gz", "c.warc", "c.warc"]
    (gap,) = [r for r in found if r.gap is not None]
    assert gap.path.endswith("b.warc") and (gap.offset, gap.length) == (0, (tmp_path / "b.warc").stat().st_size)


def test_keys_that_are_no_numbers_do_not_end_the_job(spark, tmp_path):
    pages = spark.createDataFrame([("p1", "u", "x"), ("7", "u", "y")], "page_id string, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    found = warc.page_records(warc.read_archives(spark, f"{tmp_path}/w"))
    assert sorted((r.page_id, r.payload_bytes) for r in found.collect() if r.page_id is not None) == [(7, 1)] and found.count() == 2
