"""WARC archives: choice of the responses, byte ranges, magics inside members, damaged members."""

import glob
import gzip
import random
import zlib

import pytest

from textfold.llm import warc

SCHEMA = "page_id long, url string, html string, payload int, twin string"


def expected(rows, least=0):
    """Plain version: responses are the least (page_id, url) of equal payloads, nulls last."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    first, out = {}, []
    for page_id, url, html in sorted(rows, key=order):
        payload = (html or "").encode()
        twin = payload in first and len(payload) >= least
        out.append((page_id, len(payload), warc.base32_sha1(payload), "revisit" if twin else "response", first.get(payload) if twin else None))
        first.setdefault(payload, page_id)
    return sorted(out, key=str)


def round_trip(spark, rows, path, least=0, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    warc.write_warc(df, path, least)
    return sorted(map(tuple, warc.page_records(warc.read_warc(spark, path)).collect()), key=str)


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, was)


def test_pages(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh <>/é日", k=rng.randrange(1, 3000)))) for i in range(200)]
    rows += [(500 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]  # copies
    rows += [(600, None, None), (601, "", ""), (None, "http://n/", "only here"), (None, None, rows[3][2]), (None, None, "twice null"),
             (None, None, "twice null"), (-5, "http://x/\r\nWARC-Type: x ", rows[9][2]), (602, "http://big/", "x" * 300_000)]
    rows += [(700, "http://same/", "the same row")] * 9
    want = expected(rows)
    small_ranges(2000)
    assert round_trip(spark, rows, str(tmp_path / "a")) == want
    small_ranges(1 << 27)
    assert round_trip(spark, rows, str(tmp_path / "b"), parts=1) == want
    assert round_trip(spark, rows, str(tmp_path / "c"), least=9) == expected(rows, 9)
    assert round_trip(spark, [], str(tmp_path / "d")) == []
    files = glob.glob(str(tmp_path / "b" / "part-*"))  # ordinary gzip files, whose members are records
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    uri = {r["record_id"]: r["target_uri"] for r in warc.read_warc(spark, str(tmp_path / "b")).collect()}
    assert uri["<urn:page:-5>"] == "http://x/%0D%0AWARC-Type:%20x%20" and uri["<urn:page:600>"] is None


def stored(data):
    """A member of uncompressed blocks, in which the bytes of the data stand as they are."""
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def archives():
    """(payload, member): magics and whole archives inside members."""
    rng = random.Random(2)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    rec = lambda i, p: warc.record(i, f"u{i}", p, warc.base32_sha1(p), False)
    inner = b"".join(warc._member(rec(900 + i, noise(300))) for i in range(6))
    payloads = [b"plain", noise(3000), warc.MAGIC * 50, inner, warc.MAGIC + b"\x00" + noise(500), b"", noise(2000) + inner + noise(10), noise(9000), b"end"]
    return [(p, (stored if n % 2 or warc.MAGIC in p else warc._member)(rec(n, p))) for n, p in enumerate(payloads)]


@pytest.mark.parametrize("size", [64, 257, 1000, 5000, 1 << 20])
def test_every_range_size_gives_the_same_records(spark, tmp_path, small_ranges, size):
    made = archives()
    for f in range(2):
        (tmp_path / f"a{f}.warc").write_bytes((b"junk before" if f else b"") + b"".join(m for _, m in made))
    small_ranges(size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted([(f"<urn:page:{n}>", p) for n, (p, _) in enumerate(made)] * 2)
    assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == want
    assert all(r["error"] is None and "sha1:" + r["payload_sha1"] == r["payload_digest"] for r in got)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_damaged_members_are_reported(spark, tmp_path, small_ranges, size):
    made = [m for _, m in archives()]
    bad = bytearray(made[7])
    bad[3000] ^= 1
    (tmp_path / "a.warc").write_bytes(made[0] + bytes(bad) + made[1] + made[8] + made[7][:4000])
    small_ranges(size)
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in got if r["error"] is None) == ["<urn:page:0>", "<urn:page:1>", "<urn:page:8>"]
    assert len([r for r in got if r["error"]]) == 2
    with pytest.raises(Exception, match="cut off|incorrect"):
        warc.page_records(warc.read_warc(spark, str(tmp_path))).collect()
