import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import corpus, frame, lower, words

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


def brute_word(inv, scores, word):
    """Sum over all segmentations, by listing them."""
    w, at = b" " + word, {p: i for i, p in enumerate(inv.pieces)}

    def all_from(i):
        if i == len(w):
            yield 0.0
        for j in range(i + 1, len(w) + 1):
            if w[i:j] in at:
                for rest in all_from(j):
                    yield scores[at[w[i:j]]] + rest

    return math.log(math.fsum(math.exp(x) for x in all_from(0)))


def test_marginals_equal_listing(path):
    from loamstone.llm.lattice_lm import Lattices, inventory

    inv = inventory(path)
    scores = inv.first_scores()
    some = [b"the", b"a", b"thinking", "été".encode(), b"tiontion", b"\xff\x00"]
    got = Lattices(inv, some).marginals(scores)
    assert np.allclose(got, [brute_word(inv, scores, w) for w in some], atol=1e-9)
    weight = np.array([1.0, 2, 3, 4, 5, 6])
    used = Lattices(inv, some).expected(scores, weight, inv.size)
    length = np.array([len(p) for p in inv.pieces])
    assert math.isclose((used * length).sum(), sum(w * (len(x) + 1) for w, x in zip(weight, some)), rel_tol=1e-9)


def test_scores_equal_brute_force(spark, path):
    from loamstone.llm import lattice_lm as m

    rows = corpus()
    docs = frame(spark, rows, repeat=False)
    got = {r.doc_id: r for r in m.scored(docs, path).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in [*words(lower(t)), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = [*words(lower(t)), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    counts = spark.createDataFrame([(0, k.encode(), x) for k, x in c.items() if k is not None], "h long, word binary, c long")
    scores = m.learned_scores(counts, path, c[None])
    assert math.isclose(np.exp(scores).sum(), 1, rel_tol=1e-9)
    inv = m.inventory(path)
    for i, t in rows[:25]:
        spelled = [x.encode() for x in words(lower(t))]
        if len(spelled) < 200:
            lp = m.Lattices(inv, spelled).marginals(scores) if spelled else []
            log = lambda k: math.log(k) if k else -math.inf
            assert math.isclose(got[i].score, (sum(lp) + scores[-1]) / math.log(10), rel_tol=1e-5)
            want = sum((np.logaddexp(log(c[w.decode()]), math.log(v) + x) - math.log(n + v)) / math.log(10) for w, x in zip(spelled, lp)) + math.log10(c[None] / n)
            assert math.isclose(got[i].word_score, want, rel_tol=1e-5)
    mean = lambda k: sum(getattr(r, k) for r in got.values() if r.held_out)
    assert all(math.isfinite(mean(k)) for k in ("score", "word_score")) and mean("word_score") > mean("score")
    assert m.scored(docs.limit(0), path).count() == 0


def test_frequent_words_and_joined_words_agree(spark, path, monkeypatch):
    from loamstone.llm import lattice_lm as m

    docs = frame(spark, corpus(3))
    want = {r.doc_id: (r.score, r.word_score) for r in m.scored(docs, path).collect()}
    full = m.frequent
    monkeypatch.setattr(m, "frequent", lambda w: full(w, 0))
    assert all(math.isclose(x, y, rel_tol=1e-9) for r in m.scored(docs, path).collect() for x, y in zip(want[r.doc_id], (r.score, r.word_score)))


def test_the_whole_vocabulary_is_there(path):
    import json

    from loamstone.llm.bpe import byte_alphabet
    from loamstone.llm.lattice_lm import inventory

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    inv = inventory(path)
    assert {bytes(alphabet[c] for c in t) for t in vocab} <= set(inv.pieces) and inv.longest == max(map(len, inv.pieces))


def test_null_ids_train_and_are_scored(spark, path):
    from loamstone.llm import lattice_lm as m

    docs = frame(spark, corpus(4)).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "text AS word", "1 AS c", "2 AS h")
    got = m.scored(docs, path).collect()
    assert len(got) == docs.count() and not any(r.held_out for r in got) and all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
