import random
import zlib

from tests.llm.helpers import corpus, frame

from loamstone.llm.sharding import Range, cut, minimax_cuts, oversized, sharded, smallest_capacity
from pyspark.sql import functions as F


def brute_capacity(sizes, k):
    best = {0: 0}
    for _ in range(k):
        best = {j: min(max(best[i], sum(sizes[i:j])) for i in best if i <= j) for j in range(len(sizes) + 1)}
    return best[len(sizes)]


def test_capacity_is_minimax():
    r = random.Random(3)
    for _ in range(60):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 12))]
        k = r.randint(1, 5)
        assert smallest_capacity(sizes, k) == brute_capacity(sizes, k)
        shard = minimax_cuts(sizes, k)
        assert shard == sorted(shard) and max(shard) < k
        assert max(sum(s for s, x in zip(sizes, shard) if x == i) for i in range(k)) == brute_capacity(sizes, k)


def test_hot_groups_have_their_own_shards():
    ranges = [Range(i << 50, 14, 10, True) for i in range(100)]
    ranges[7] = Range(7 << 50, 14, 1000, True)
    assert oversized(ranges, 10) == ([ranges[7]], [])
    ranges[7] = Range(7 << 50, 14, 1000, False)
    assert oversized(ranges, 10) == ([], [ranges[7]])


def test_cuts_are_minimax_over_single_groups(spark):
    r = random.Random(5)
    for shards, hot in ((4, 1), (7, 1), (5, 400)):
        texts = [("t%d " % i) * r.randint(1, 60) for i in range(300)]
        rows = [(i, t) for i, t in enumerate(texts + texts[:40] + [texts[9]] * hot)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))).alias("h"))
        groups = {}
        for x in docs.collect():
            groups[x.h] = groups.get(x.h, 0) + x["size"]
        own, firsts = cut(docs, shards, bits=2, step=2)
        total, alone = sum(groups.values()), []
        for h in sorted(groups, key=lambda h: -groups[h]):
            if groups[h] * (shards - len(alone)) <= total:
                break
            alone.append(h)
            total -= groups[h]
        assert [h + (1 << 63) for h in alone] == own and bool(own) == (hot > 1)
        rest = [groups[h] for h in sorted(groups) if h not in alone]
        load = {}
        for h, n in groups.items():
            if h not in alone:
                s = sum(h + (1 << 63) >= x for x in firsts)
                load[s] = load.get(s, 0) + n
        assert max(load.values()) == smallest_capacity(rest, shards - len(alone)) and len(load) <= shards - len(alone)


def test_rows_slots_and_groups(spark):
    rows = corpus(extra=["hot"] * 300)
    docs = frame(spark, rows)
    got = sharded(docs, 5).collect()
    text = dict(rows)
    assert len(got) == len(rows) + 1
    shards, of = {}, {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        shards.setdefault(r.shard, []).append(r.slot)
        of.setdefault(data, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len(s) == 1 for s in of.values())
    assert sharded(docs.limit(0), 5).count() == 0
