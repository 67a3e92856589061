"""Operators on small inputs: cases that the registered queries don't reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import governance as G
from loamstone.operators import graph as N
from loamstone.operators import jobs as J
from loamstone.operators import memory as M
from loamstone.operators import retrieval as R
from loamstone.sources.markdown import markdown
from loamstone.streaming import events as E

NOW = 1706745600


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_entities_links_and_han_words(spark):
    t = "见 [[ 合同法 |alias]] and foo_bar, x1 αβγ 劳动合同 可以"
    assert one(spark, X.wikilinks(F.lit(t))) == ["合同法"]
    got = one(spark, X.entities(F.lit(t)))
    assert got[0] == "合同法" and "劳动合同" in got and "动合" in got and "可以" not in got and got[-1] == "foo_bar" and "and" in got
    assert one(spark, X.entities(F.lit(None).cast("string"))) == []
    assert one(spark, X.listed(F.lit("a，b; a|c"))) == ["a", "b", "c"]
    assert X.query_terms("劳动合同 AI ml-ops ml-ops") == ["劳动合", "动合同", "ml-ops"] and X.query_terms("样品，发货 Abc", segment=lambda t: ["样品", "发货"]) == ["样品发货", "Abc"] and X.query_terms("ab") == ["ab"]
    assert X.loose_json("sure:\n```json\n{\"a\": 1}\n```") == {"a": 1} and X.loose_json("no") is None
    assert one(spark, S.masked(F.lit("secret1234"))) == "***1234"
    assert S.depth("l3") == "Q3" and S.depth(None) == "Q2"
    assert [one(spark, X.truthy(F.lit(v))) for v in ("是", "YES ", "no")] == [True, True, False]


def test_states_stability_and_review(spark):
    rows = [("a", NOW - 1 * 86400), ("b", NOW - 5 * 86400), ("c", NOW - 20 * 86400), ("d", NOW - 60 * 86400)]
    m = spark.createDataFrame([(i, t, t, "semantic", 14.0, 0, 0.0, 0.5, 0.0, 0.0, 2) for i, t in rows], "id string, created_ts long, last_recall_ts long, kind string, stability double, recall_count int, emotional_tag double, novelty double, connection_density double, predictive_value double, importance int")
    assert {r.id: r.tier for r in M.states(m, NOW).collect()} == {"a": "foreground", "b": "active", "c": "latent", "d": "deep"}
    cards = spark.createDataFrame([("x", 2.5, 0, 0)], "memory_id string, ef double, interval_days int, repetitions int")
    grades = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("x", 3, 5), ("x", 4, 1)], "memory_id string, seq int, grade int")
    r = M.graded_in_order(cards, grades.filter("seq < 4")).first()
    assert (r.interval_days, r.repetitions, round(r.ef, 2)) == (8, 3, 2.8)
    assert M.graded_in_order(cards, grades).first().repetitions == 0


def test_packing_keeps_budgets_and_new_coverage(spark):
    rows = [("q", "a", 1.0, 0.03, "x" * 50, ["d1"]), ("q", "b", 0.9, 0.01, "y" * 50, ["d1"]), ("q", "c", 0.8, 0.01, "z" * 50, ["d2"]), ("q", "d", 0.7, 0.05, "w" * 50, ["d1"])]
    df = spark.createDataFrame(rows, "query string, id string, score double, rrf_score double, snippet string, coverage array<string>").withColumn("sim", F.lit(0.0))
    told = lambda *budgets: {r.id: (r.position, r.tokens, r.stop) for r in G.packed(df, *budgets).collect()}
    assert told(8, 120, 1000) == {"a": (1, 50, ""), "b": (None, 0, "coverage_duplicate"), "c": (2, 50, ""), "d": (3, 20, "")}
    assert told(1, 1000, 1000) == {"a": (1, 50, ""), **dict.fromkeys("bcd", (None, 0, "item_budget_dropped"))}
    assert told(8, 50, 1000)["c"][2] == "char_budget_dropped" and told(8, 1000, 50)["c"][2] == "token_budget_dropped" and told(8, 30, 100)["a"] == (1, 30, "")
    r = random.Random(1)
    for _ in range(6):
        rows = [("q", f"i{i:02d}", round(r.random(), 1), r.choice([0.01, 0.03]), "s" * r.randint(0, 40), r.sample("abcdef", r.randint(0, 2)), 0.0) for i in range(25)]
        budgets = r.randint(1, 9), r.randint(20, 300), r.randint(20, 300)
        chosen, used, covered = [], 0, set()
        for _, i, _, fused, text, cover, _ in sorted(rows, key=lambda x: (-x[2], -x[3], x[1])):
            if len(chosen) < budgets[0] and used < min(budgets[1:]) and text and not (chosen and not set(cover) - covered and fused < 0.02):
                cut = text[: min(budgets[1:]) - used]
                used, covered = used + len(cut), covered | set(cover)
                chosen.append((i, cut))
        df = spark.createDataFrame(rows, "query string, id string, score double, rrf_score double, snippet string, coverage array<string>, sim double")
        assert [(x.id, x.snippet) for x in G.packed(df, *budgets).filter("stop = ''").orderBy("position").collect()] == chosen


def test_dream_effect_is_capped_and_decays(spark):
    ev = spark.createDataFrame([("m", "2024-01-01", 3)] * 6 + [("n", "2024-03-01", 3)], "memory_id string, d string, phase_count int").withColumn("occurred_date", F.to_date("d"))
    day = {r.memory_id: r.dream for r in G.dream_effect(ev, "2024-01-01").collect()}
    assert day == {"m": pytest.approx(0.12)}
    assert G.dream_effect(ev, "2024-01-31").first().dream == pytest.approx(0.105, abs=0.002)


def test_bounded_graph_and_paths(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "d", 3.0), ("c", "x", 1.0)], "src string, dst string, weight double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    seeds = spark.createDataFrame([("a", 1)], "id string, position int")
    assert {r.id: r.rank for r in N.bounded_ranks(e, seeds, ids("b", "c"), 10).collect()} == {"c": 1, "b": 2}
    r = N.shortest(e, ids("a"), ids("x")).first()
    assert (r.hops, r.path, r.connector) == (3, ["a", "b", "c", "x"], "c")
    assert N.shortest(e, ids("x"), ids("a"), 2).count() == 0


def test_first_writer_bundles_and_touch(spark):
    rows = spark.createDataFrame([("1", 5, "s"), ("2", 3, "s"), ("3", 1, None), ("4", 1, None)], "id string, created_ts long, source_id string")
    assert {r.id for r in M.first_of_source(rows).collect()} == {"2", "3", "4"}
    assert {r.id for r in M.first_of_source(rows, rows.filter("id = '1'")).collect()} == {"3", "4"}
    ep = spark.createDataFrame([("mb-" + "a" * 12, 2, "b"), ("mb-" + "a" * 12, 1, '{"content": "a"}'), ("bad", 1, "x")], "bundle_id string, chunk_index long, content string")
    assert [(r.n_parts, r.content) for r in M.bundle(ep).collect()] == [(2, "ab")]


def test_vectors_replicas_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 5, NOW, "semantic"), ("b", "x", 0, 0, "semantic"), ("c", None, 0, 0, "semantic")], "id string, content string, importance int, created_ts long, kind string")
    v = {r.memory_id: r.vec for r in J.embedded(rows, dim=8).collect()}
    assert v["a"] == v["b"] and abs(sum(x * x for x in v["c"]) - 1) < 1e-5
    near = R.nearest(spark.createDataFrame([(k, list(x)) for k, x in v.items()], "memory_id string, vec array<float>"), list(v["a"]), 2).collect()
    assert [r.memory_id for r in near] == ["a", "b"]
    shards = J.replicas(rows, "k", NOW)
    assert {r.memory_id: r["count"] for r in shards.groupBy("memory_id").count().collect()} == {"a": 5, "b": 2, "c": 2}
    lost = shards.filter("NOT (memory_id = 'b')").unionByName(shards.filter("memory_id = 'b'").withColumn("sha256", F.lit("0")))
    assert {r.memory_id for r in J.restored(lost, "k").collect()} == {"a", "c"} and J.restored(shards, "wrong").count() == 0
    for n in range(9):
        assert J.snapshot(rows, str(tmp_path / "snap"), n, keep=3)
    assert sorted(p.name for p in (tmp_path / "snap").glob("v=*")) == ["v=6", "v=7", "v=8"]


def test_job_runner_retries_and_stops(spark, tmp_path):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return 7

    r = J.run_steps([("a", flaky), ("b", lambda: 1 / 0), ("c", lambda: 1)], {"a": [0, 0]}, sleep=lambda s: None)
    assert r["status"] == "failed" and r["failed_step"] == "b" and [s["step"] for s in r["steps"]] == ["a", "b"] and r["steps"][0]["result"] == 7
    J.write_receipt(spark, r, str(tmp_path / "runs"))
    assert json.loads(spark.read.parquet(str(tmp_path / "runs")).first().receipt)["failed_step"] == "b"


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: Rule\ndescription: \"d\"\nmetadata:\n  type: feedback\n---\nbody\n")
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "MEMORY.md").write_text("x")
    got = {r.name: (r.kind, r.content) for r in markdown(spark, str(tmp_path)).collect()}
    assert got == {"Rule": ("procedural", "d\n\nbody"), "b": ("semantic", "plain")}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 40, i, "click", 1.0, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double, user_id long").withColumn("ts", F.timestamp_seconds(F.lit(NOW) + F.col("s") * 600)).drop("s")
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    stream = E.read(spark, src, df.schema, 1)
    once = E.drained(E.deduplicated(stream), "once", checkpoint=str(tmp_path / "c1"))
    assert once.count() == 40 and once.select("event_id").distinct().count() == 40
    seen = E.drained(E.seen_counts(E.read(spark, src, df.schema)), "seen", "complete", str(tmp_path / "c2"))
    assert {r.memory_id: r.seen for r in seen.collect()} == {f"m-{i}": 20 for i in range(3)}
    win = E.drained(E.windowed(E.read(spark, src, df.schema), late="0 seconds"), "win", "append", str(tmp_path / "c3"))
    assert win.agg(F.sum("n")).first()[0] <= 60 and win.select("start", "event_type").distinct().count() == win.count()
    out = str(tmp_path / "out")
    for k in range(2):
        E.upsert(E.read(spark, src, df.schema, 1), out, str(tmp_path / f"u{k}"), "event_id").awaitTermination()
    assert spark.read.parquet(out).count() == 40 and E.retained(spark.read.parquet(out).withColumnRenamed("event_id", "run_id"), 5).count() == 5
