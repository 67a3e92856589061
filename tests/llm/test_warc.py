import gzip
import hashlib
import io
import zlib

import pytest

from loamstone.llm.warc import ArchiveReader, WarcError, planned, read, record, round_trip, write

SCHEMA = "page_id long, url string, html string, digest string, refers_to long"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}" if i % 2 else None, h, "no", 1) for i, h in rows], SCHEMA).repartition(3)


ROWS = [(9, "a" * 100), (3, "a" * 100), (5, "a" * 99), (6, "a" * 99), (7, None), (8, ""), (1, "é\r\n\r\n\0" * 40), (2, "é\r\n\r\n\0" * 40), (4, "b" * 300_000), (10, "b" * 300_000)]


def test_round_trip(spark, tmp_path):
    df = pages(spark, ROWS)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(df).collect()}
    first = {}
    for i, h in sorted(ROWS):
        first.setdefault(h or "", i)
    want = {}
    for i, h in ROWS:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h or ""] != i
        want[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)
    assert got == want
    write(df, str(tmp_path / "w"), records=2, chunks=1)
    bodies = {r.page_id: r.payload for r in read(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert all(bytes(b) == (dict(ROWS)[i] or "").encode() for i, b in bodies.items())
    assert len(list((tmp_path / "w").glob("part-*"))) >= 5
    whole = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert sum(gzip.GzipFile(fileobj=io.BytesIO(d)).read().count(b"WARC/1.1\r\n") for d in whole) == len(ROWS)  # common tools read all of it
    for d in whole:  # nothing but members
        while d:
            one = zlib.decompressobj(31)
            one.decompress(d)
            assert one.eof
            d = one.unused_data
    assert round_trip(df.limit(0)).count() == 0
    assert planned(df.limit(0)).count() == 0


def test_damage_is_found():
    good = record(1, "u", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None, "2000-01-01T00:00:00Z")
    assert len(list(ArchiveReader(good + b"\0\0" + good))) == 2
    plain = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(plain.replace(b"payload", b"pAyload", 1)), gzip.compress(plain[:-4]), gzip.compress(plain + b"x"), gzip.compress(b"HTTP/1.1\r\n\r\n"), b"junk"):
        with pytest.raises(WarcError):
            list(ArchiveReader(bad))


def test_large_records(spark, tmp_path):
    big = "".join(chr(97 + (i * i) % 26) for i in range(1 << 14)) * (17 << 6)  # 17 MiB: the member's last byte isn't zero
    rows = [(1, big), (2, "small"), (3, big)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").coalesce(1)
    write(df, str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in read(spark, str(tmp_path / "w"), payloads=False).collect()}
    assert got == {1: ("response", len(big), None), 2: ("response", 5, None), 3: ("revisit", len(big), 1)}
