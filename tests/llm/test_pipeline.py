from tests.llm import test_decontaminate, test_ngram_join
from tests.llm.helpers import corpus


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    from loamstone.llm.quality import verdicts

    leak = " ".join(f"leak{i}" for i in range(30))
    body = " ".join(f"word{i * 7 % 90}" for i in range(60))
    rows = corpus(extra=[f"{body} {leak} end.", f"{body} new mail ann@x.org and {leak[:40]}", "!!! " * 40])
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = {r.doc_id for r in verdicts(frame).filter("kept").collect()}
    kept = [(i, t) for i, t in rows if i in good]
    _, _, at = test_ngram_join.brute(kept, 5, 4 / 5)
    kept = [(i, t) for i, t in kept if at[i] == i]
    dirty = {i for i, *_ in test_decontaminate.brute(kept, [(1, leak)])}
    assert dirty
    out = p.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, _ in kept} - dirty
    text = dict(rows)
    assert all(got[i].text == text[i] or "ann@x.org" in text[i] for i in got)
    assert out.columns[:5] == frame.columns and "ann@x.org" not in " ".join(r.text for r in got.values())
    assert all(r.n_tokens == len(r.ids) > 0 for r in got.values())
