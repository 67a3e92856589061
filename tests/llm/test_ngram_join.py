from collections import Counter, defaultdict
from fractions import Fraction

from tests.llm.helpers import corpus, frame, lower, words

from loamstone.llm.components import components
from loamstone.llm.ngram_join import all_links, keep_one, near_duplicates


def brute(rows, k, t):
    sets = {}
    for i, text in rows:
        w = words(lower(text))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b]) or 1) >= t}
    return sets, links, reach(sets, links)


def reach(ids, links):
    at = {i: i for i in ids}
    for _ in at:
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_components_and_links_equal_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows)
    for k, t in ((3, (9, 10)), (5, (4, 5)), (2, (1, 2))):
        sets, links, at = brute(rows, k, Fraction(*t))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, k, t).collect()}
        assert got == {i: (len(sets[i]), at[i]) for i in sets}
        first = {}
        for i in sorted(sets):
            first.setdefault(sets[i], i)
        between = {(a, b) for a, b in links if first[sets[a]] == a and first[sets[b]] == b and sets[a] != sets[b]}
        assert {(r.a, r.b) for r in all_links(docs, k, t).collect()} == between
    kept = keep_one(docs)
    _, _, at = brute(rows, 5, Fraction(4, 5))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(at.values())) and kept.columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 150)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = defaultdict(int, {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 150, 150: 150})
    assert got == dict(want)


def test_keep_one_with_null_and_repeated_ids(spark):
    say = lambda s: " ".join(f"{s}{i}" for i in range(20))
    rows = [(None, say("a")), (None, say("b")), (None, say("b")), (5, say("c")), (5, say("d")), (5, say("d")), (3, say("e")), (9, say("d")), (2, say("f")), (None, say("f")), (None, say("f") + " end")]
    rows += [(7, ""), (7, ""), (7, say("g")), (None, ""), (None, None), (8, " ")]
    got = Counter((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter([(None, say("a")), (None, say("b")), (5, say("c")), (5, say("d")), (3, say("e")), (2, say("f")), (7, ""), (7, say("g")), (None, ""), (None, None), (8, " ")])
