from collections import Counter

from tests.llm.helpers import corpus, frame, words

from loamstone.llm.quality import Estimate, Rule, cascade, default_rules, estimates, keep_good, measured, ordered, verdicts


def brute(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    rows = corpus(extra=["a b c d e f g h " * 9, "a#b *c| " * 30, "é ñ\x0bü\n\nx\nx\n", "\n\n"])
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in measured(docs).collect()}
    assert got == {i: brute(t) for i, t in rows}
    out = verdicts(docs)
    for r in out.collect():
        n, _, _, _, repeats = brute(r.text)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    both = [{r.doc_id for r in measured(docs).filter(cascade(default_rules(measures=m)).isNull()).collect()} for m in (False, True)]
    assert both[0] == both[1]
    assert out.count() == len(rows) + 1


def test_order_never_changes_the_verdict(spark):
    docs = frame(spark, corpus(extra=["X" * 5 + " YY" * 30, "a | b | c | " * 20, "wow!! " * 40]))
    rules = default_rules()
    kept = [{r.doc_id for r in docs.filter(cascade(order).isNull()).collect()} for order in (rules, rules[::-1], ordered(estimates(docs, rules, 10)))]
    assert kept[0] == kept[1] == kept[2]
    good = {r.doc_id for r in verdicts(docs).filter("kept").collect()}
    assert {r.doc_id for r in keep_good(docs).collect()} == good
    assert keep_good(docs).columns == docs.columns


def test_greedy_order_is_conditional():
    rule = lambda name: Rule(name, None)
    a, b, c = (Estimate(rule("a"), 1.0, (True, True, True, False, False)), Estimate(rule("b"), 1.0, (True, True, False, False, False)), Estimate(rule("c"), 2.0, (False, False, False, True, True)))
    assert [r.name for r in ordered([b, c, a])] == ["a", "c", "b"]
    assert [r.name for r in ordered([Estimate(rule("slow"), 2.0, ()), Estimate(rule("fast"), 1.0, ())])] == ["fast", "slow"]


def test_each_rule_rejects(spark):
    texts = {"symbols": "a # b | c " * 9, "shouting": "THIS IS LOUD talk " * 8, "exclamations": "so good!! " * 20, "word_length": "x" * 400, "dup_lines": "again and again\n" * 9 + "once",
        "bullets": "\n".join(f"* point number {i}" for i in range(9)), "ellipses": "\n".join(f"and then {i} came ..." for i in range(9)), "no_letters": " ".join(str(i) for i in range(100, 160))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    for rule in default_rules():
        assert rule.name in {r.doc_id for r in docs.filter(rule.rejects).collect()}
    fine = spark.createDataFrame([("The harbour was quiet that morning, and the boats lay still.\n" + "Nobody spoke of the storm until the ferry had gone out again.",)], "text string")
    assert fine.filter(cascade(default_rules()).isNull()).count() == 1


def test_empty_table(spark):
    assert verdicts(frame(spark, [(1, "x")]).limit(0)).count() == 0
