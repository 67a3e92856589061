import random
import re
import string

from tests.llm.helpers import corpus, frame, lower

from loamstone.llm.decontaminate import band_rows, contained, without_contained


def fold(s):
    return "".join(" " if c in string.punctuation else c for c in lower(s))


def brute(docs, items, k=5):
    cut = lambda s: re.findall(r"[^\x20\x09-\x0D]+", fold(s))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for j, t in items:
        q = cut(t)
        if not q:
            continue
        n = min(k, len(q))
        want = grams(q, n)
        out |= {(i, j, len(want), len(want & grams(cut(d), n))) for i, d in docs if 5 * len(want & grams(cut(d), n)) >= 4 * len(want)}
    return out


def test_pairs_equal_brute_force(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(5, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "solo"), (53, "two Words"), (54, "a, b. c d"), (55, say(9) + "!")]
    texts = [say(80) for _ in range(20)]
    for i, t in items[:30]:
        w = t.split()
        if i % 3 == 0:
            w[len(w) // 2] = "changed"
        texts.append(say(r.randint(0, 2000)) + " " + ", ".join(w).upper() + " " + say(30))
    texts += [" ".join(t for _, t in items[:40]), "x solo y", "two words", "a b c d", items[3][1]]
    rows = corpus(extra=texts)
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items] + [(3, items[3][1], "y", 2)], "item_id long, text string, doc_id string, n long")
    assert {tuple(x) for x in contained(docs, bench).collect()} == brute(rows, items)
    gone = {i for i, *_ in brute(rows, items)}
    kept = without_contained(docs, bench)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - gone and kept.columns == docs.columns
    assert contained(docs, bench.limit(0)).count() == 0 and contained(docs.limit(0), bench).count() == 0


def test_bands_keep_their_recall():
    assert band_rows(32, 40, (4, 5)) == 4 or band_rows(32, 40, (4, 5)) == 2
    assert band_rows(16, 200, (4, 5)) in (0, 1)
    assert band_rows(1, 1 << 20, (4, 5)) == 0


def test_null_ids(spark):
    item = " ".join(f"leak{i}" for i in range(30))
    rows = [(None, "so " + item), (None, "clean"), (1, item + " ok"), (1, "clean too"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, None)], "item_id long, text string")
    assert {tuple(r) for r in without_contained(docs, bench).collect()} == {(None, "clean"), (1, "clean too"), (2, None)}
    assert contained(docs, bench).count() == 0
    again = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in contained(docs, again).collect()} == {1}
