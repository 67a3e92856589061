import random

import pytest

from tests.llm.helpers import corpus, frame

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
LETTERS = [*"ab' sS\n\t  .!1é\xa0 　\x0b\x0c\r\x1c\x85中<|Σİ߀İŉǰÀ́éö가각각क़क़ががกำุ่①²½ﬁ😀‍", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "'re", "'VE"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_equals_the_library(library):
    from loamstone.llm.token_counts import PrefixCounter, longest_within

    r, own = random.Random(5), PrefixCounter(PATH)
    texts = [t or "" for _, t in corpus()] + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["unbelievably" * 30, "ა" * 90, "'" * 40]
    for t in texts:
        got = own.prefixes(t)
        at = range(len(t) + 1) if len(t) < 1500 else [len(t), *(r.randrange(len(t)) for _ in range(15))]
        assert [int(got[k]) for k in at] == sizes(library, [t[:k] for k in at]), t
        most = longest_within(got)
        assert len(most) == got[-1] + 1
        assert all(most[b] == max(k for k in range(len(t) + 1) if got[k] <= b) for b in (range(len(most)) if len(t) < 300 else [0, len(most) - 1, len(most) // 2]))


def test_caches_change_nothing(library, monkeypatch):
    from loamstone.llm import token_counts as M

    monkeypatch.setattr(M, "CACHED", 3)
    own = M.PrefixCounter(PATH)
    texts = [t or "" for _, t in corpus(9)]
    own.learn(texts)
    assert [int(own.prefixes(t)[-1]) for t in texts] == sizes(library, texts)


def test_questions_of_budgets(spark, library):
    from pyspark.sql import functions as F

    from loamstone.llm.token_counts import chars_within, counted, tokens_at, tokens_in, truncated, with_counts

    rows = corpus()
    docs = frame(spark, rows).withColumn("prefix_tokens", F.lit("own"))
    held = with_counts(docs, PATH)
    assert held.columns == [*(c for c in docs.columns if c != "prefix_tokens"), "prefix_tokens", "budget_chars"]
    out = held.select("doc_id", "text", tokens_in().alias("n"), tokens_at(9).alias("at"), tokens_at(F.lit(-3)).alias("none"), chars_within(7).alias("fit"), chars_within(-1).alias("never"), truncated(7).alias("cut")).collect()
    assert len(out) == len(rows) + 1
    for x in out:
        t = x.text or ""
        assert (x.n, x.at, x.none, x.never) == (*sizes(library, [t, t[:9]]), 0, None)
        assert x.cut == t[: x.fit] and sizes(library, [x.cut])[0] <= 7
        assert x.fit == len(t) or sizes(library, [t[: x.fit + 1]])[0] > 7
    small = {x.doc_id: x for x in counted(docs, PATH, limit=30).collect()}
    assert {i: (x.n_bytes, x.n_tokens, x.over_limit) for i, x in small.items()} == {i: (len((t or "").encode()), n, n > 30) for (i, t), n in zip(rows, sizes(library, [t or "" for _, t in rows]))}
    assert counted(docs.limit(0), PATH).count() == 0
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(x.n_tokens for x in counted(none, PATH).collect()) == sorted(x.n for x in out)
