import hashlib
import random

import pyarrow as pa
import pytest

from tests.llm.helpers import corpus, frame

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


def test_equals_the_library(spark, path):
    from tokenizers import Tokenizer

    from loamstone.llm.bpe import decode, digests, encode

    r = random.Random(5)
    letters = [*"ab' sS\n\t  .!1é\xa0 　\x0b\x0c\r\x1c\x85中<|", "<|endoftext|>", "'s", "'ll"]
    rows = corpus(extra=["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(200)])
    docs = frame(spark, rows)
    t = Tokenizer.from_file(path)
    want = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in digests(docs, path).collect()} == want
    coded = encode(docs, path)
    assert {x.doc_id: x.ids for x in coded.collect()} == {i: t.encode(s or "", add_special_tokens=False).ids for i, s in rows}
    assert {x.doc_id: x.text for x in decode(coded, path).collect()} == {i: s or "" for i, s in rows}
    assert digests(docs.limit(0), path).count() == 0


def test_han_text_is_cut_and_equal_to_the_library():
    import random

    from loamstone.llm.bpe import codec
    from loamstone.llm.kernel import text_buffer
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own, r = Tokenizer.from_file(path), codec(path), random.Random(1)
    han = lambda n: "".join(chr(r.choice([r.randint(0x4E00, 0x9FFF), 0x7684, 0x4E00, 0x9FA5, r.randint(0x3040, 0x30FF), 0x3400])) for _ in range(n))
    texts = [han(r.randint(0, 60)) + r.choice(["", " ", "。", "ab'sé", "\u3000", "7", "𠀀"]) + han(r.randint(0, 9)) for _ in range(400)] + [han(5000), "中", "中文", ""]
    buf, offs = text_buffer(pa.array(texts))
    ids, first = own.encode(buf, offs)
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(own.cuts(buf, offs)) > 3 * len(texts)


def test_cuts_in_any_script_are_equal_to_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from loamstone.llm import bpe
    from loamstone.llm.kernel import text_buffer

    path = P.path("byte_bpe_50k.json")
    library, r = Tokenizer.from_file(path), random.Random(3)
    ranges = [(0xE01, 0xE5B), (0x0900, 0x0970), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x3041, 0x30FF), (0x0410, 0x044F), (0x0600, 0x06FF), (0x1F600, 0x1F64F), (0x0300, 0x036F), (0x21, 0x7E), (0x2000, 0x2070), (0x80, 0x250), (0x20, 0x30)]
    pieces = ["'s", "'ll", "'", "''", " ", "  ", "\n", "<|endoftext|>", "https://a.b/c?d=e&f", "QUJDREVGR0g=", "\u3000", "\u2009", "ll", "re"]
    say = lambda: "".join(chr(r.randint(*r.choice(ranges))) if r.random() < 0.8 else r.choice(pieces) for _ in range(r.randint(0, 30)))
    texts = [say() for _ in range(1500)] + ["ก" * 900, "https://example.org/" + "x7Qz" * 500, "'" * 30 + "sale"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    buf, offs = text_buffer(pa.array(texts))
    for weak in (False, True):
        if weak:  # hashes that many fragments share
            monkeypatch.setattr(bpe, "hash_spans", lambda b, a, z, seed=0: (z - a).astype("uint64"))
        own = bpe.ForcedBoundaryBpe(path)
        for _ in range(2):
            ids, first = own.encode(buf, offs)
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
    assert len(own.cuts(*text_buffer(pa.array(["中文字符测试" * 50])))) > 50


def test_no_worker_keeps_a_vocabulary(spark, path):
    from loamstone.llm.bpe import digests, encode

    rows = frame(spark, corpus()).repartition(8)

    def held(batches):
        import pyarrow as pa

        from loamstone.llm import bpe

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.codec.cache_info().currsize] * b.num_rows)], names=["n"])

    for out in (encode(rows, path), digests(rows, path)):
        out.write.format("noop").mode("overwrite").save()
        assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
