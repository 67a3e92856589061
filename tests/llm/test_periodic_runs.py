import hashlib
import random
import zlib

import numpy as np

from tests.llm.helpers import corpus, frame, words


def brute(w, least=6, times=4):
    """Maximal stretches of each period, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        w = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 40))]
        unit = [r.choice("abc") for _ in range(r.randint(1, 9))]
        yield " ".join(w + unit * r.randint(0, 9) + unit[: r.randrange(len(unit))] + w[: r.randint(0, 20)])


def test_equals_comparing_all_words():
    from loamstone.llm.periodic_runs import _chunk

    some = [*texts(3, 1500)]
    for least, times in ((6, 4), (2, 2), (9, 3)):
        found, kept = _chunk([t.encode() for t in some], least, times)
        for t, f, k in zip(some, found, kept):
            want = brute(t.split(), least, times)
            assert [tuple(x) for x in f.tolist()] == want
            assert k.decode() == collapsed(t.split(), want)


def test_equal_hashes_of_unequal_words_change_nothing(monkeypatch):
    from loamstone.llm import periodic_runs as M

    some = [*texts(4, 300)]
    monkeypatch.setattr(M, "mixed", lambda a: a & np.uint64(1))
    monkeypatch.setattr(M, "PAIRS", 50)
    found, _ = M._chunk([t.encode() for t in some], 6, 4)
    assert [[tuple(x) for x in f.tolist()] for f in found] == [brute(t.split()) for t in some]


def test_words_whose_hashes_are_alike_in_powers_of_two():
    """Thue's and Morse's sequence, on which prefix hashes modulo 2^64 fail."""
    from loamstone.llm.periodic_runs import _chunk

    w = "ab"
    for _ in range(11):
        w += w.translate(str.maketrans("ab", "ba"))
    found, _ = _chunk([" ".join(w).encode(), " ".join(w * 4).encode()], 6, 4)
    assert [f.tolist() for f in found] == [[], [[0, 4 * len(w), len(w)]]]


def test_query_equals_brute_force(spark):
    from pyspark.sql import functions as F

    from loamstone.llm.periodic_runs import digests, with_runs

    rows = corpus(extra=[*texts(5, 300), "x " * 5000, " ".join(["very long"] * 9000), "a\x1cb " * 9, "é　é " * 8])
    docs = frame(spark, rows)
    want = {}
    for i, t in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = brute(w) if len(w) < 3000 else None
        if runs is None:
            runs = [(0, len(w), 1)] if len(set(w)) == 1 else [(0, len(w), 2)] if len(set(w)) == 2 else []
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i] = (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))
    got = digests(docs).collect()
    assert len(got) == len(rows) + 1
    assert {x.doc_id: tuple(x)[1:] for x in got} == want
    assert sum(v[0] > 0 for v in want.values()) > 100
    assert digests(docs.limit(0)).count() == 0
    held = with_runs(docs.withColumn("runs", F.lit(1)).withColumn("doc_id", F.lit(None).cast("long")))
    assert held.columns[-2:] == ["runs", "collapsed"] and held.filter("text IS NULL").select(F.size("runs"), "collapsed").first()[:] == (0, "")
