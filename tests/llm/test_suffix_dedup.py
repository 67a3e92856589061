import hashlib
import random

import pytest

from tests.llm.helpers import corpus, frame

from loamstone.llm import suffix_dedup
from loamstone.llm.suffix_dedup import deduplicated


def brute(rows, length=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], i)
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("often", [1000, 3])
def test_equals_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(suffix_dedup, "HOT", often)  # 3: hot ranks are split
    r = random.Random(2)
    shared = ["".join(r.choice("abc é") for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    own = lambda n: "".join(r.choice("defghij ") for _ in range(n))
    extra = [own(r.randint(0, 90)) + s + own(r.randint(0, 90)) for s in shared for _ in range(4)]
    extra += ["z" * 120, "z" * 70, "y" * 300, own(30) + shared[4][50:150] + own(20) + shared[3], shared[4][:60] + shared[4][140:], "ab" * 60, "ba" * 60]
    extra += [shared[4][r.randint(0, 60) : r.randint(100, 200)] for _ in range(12)]
    rows = corpus(extra=extra)
    docs = frame(spark, rows)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in deduplicated(docs).collect()}
    want = brute(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert deduplicated(docs).count() == len(rows) + 1
    single = deduplicated(frame(spark, rows, repeat=False), keep_text=False)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in single.collect()} == want
    assert deduplicated(docs.limit(0)).count() == 0


def test_null_ids_and_a_long_text(spark):
    r = random.Random(4)
    whole = "".join(r.choice("abcdefghij ") for _ in range(300_000))
    rows = [(None, whole[:400]), (None, whole[1000:1300]), (5, whole), (6, whole[200_000:201_000] + "-" + whole[100:300])]
    got = {(x.doc_id, x.n_bytes): (x.n_removed, x.n_spans) for x in deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()}
    assert got == {(None, 400): (0, 0), (None, 300): (0, 0), (5, 300_000): (700, 2), (6, 1201): (1200, 2)}


def test_nothing_repeated(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 60) for i in range(10, 30)], "doc_id long, text string")
    assert {(r.n_removed, r.n_spans) for r in deduplicated(docs).collect()} == {(0, 0)}


def test_a_window_of_all_documents_comes_once_from_each_task(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    most = []
    real = suffix_dedup.repeated_runs

    def counted(found, length):
        most.append(found.filter("context IS NOT NULL").groupBy("rank").count().agg({"count": "max"}).first()[0])
        return real(found, length)

    monkeypatch.setattr(suffix_dedup, "repeated_runs", counted)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    try:
        r = random.Random(7)
        own = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
        line, half = "=" + own(62) + "=", own(60)
        rows = [(i, own(r.randint(20, 80)) + line + own(r.randint(5, 60)) + (half if i % 3 == 0 else "")) for i in range(400)]
        r.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in deduplicated(docs).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == brute(rows)
    assert max(most) <= 12  # two tasks, and those over the blocks' first texts, for 80 batches


def test_blocks_with_one_hash_are_the_same():
    import numpy as np

    from loamstone.llm.suffix_dedup import blocks

    r = np.random.default_rng(3)
    for sizes in ([900, 0, 20, 700], [10], []):
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        buf = r.integers(97, 100, int(offs[-1])).astype(np.uint8)
        both, one = blocks(buf, offs), blocks(buf, offs, second=False)
        assert len(both) == 5 and len(one) == 4 and all((x == y).all() for x, y in zip(both, one))
