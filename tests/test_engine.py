import time

import pytest
from pyspark.sql import functions as F

from loamstone.engine import Engine
from loamstone.operators import jobs as J
from loamstone.sources.markdown import markdown

EVIDENCE = [{"type": "episode", "locator": "turn://one", "excerpt": "one", "observed_at": "2026-08-08"}, {"type": "review", "locator": "review://two", "excerpt": "two", "observed_at": "2026-08-09"}]
FIELDS = {"source": "test", "observed_at": "2026-08-08", "valid_from": "2026-08-08", "valid_to": "2027-08-08"}


@pytest.fixture()
def engine(spark, tmp_path):
    clock = [1_700_000_000]
    e = Engine(spark, str(tmp_path / "db"), lambda: clock[0], owner="jim", embed=lambda texts, dim: J.hash_embedding(texts, dim), dim=16)
    e.clock = clock
    return e


def governed(engine, name, tier="M0", verified=False, evidence=(), **meta):
    engine.store({"id": name, "kind": "semantic", "content": f"governed memory {name}", "meta": {"memory_tier": tier, "verification_status": "verified" if verified else "unreviewed", "review_status": "active" if verified else "quarantine", "evidence": list(evidence), "source_id": f"test:{name}", **FIELDS, **meta}}, trusted=True)


def test_store_recall_review_forget(engine):
    ids = engine.store_batch([
        {"kind": "procedural", "content": "deploy alpha_service with beta_flag", "importance": 5, "source_id": "s1"},
        {"kind": "semantic", "content": "alpha_service uses beta_flag and gamma_cache"},
        {"kind": "semantic", "content": "nothing here", "importance": 0},
        {"kind": "semantic", "content": "again", "source_id": "s1"},
    ])
    assert ids[0] == ids[3] and engine.table("memories").count() == 3
    assert engine.table("review_state").count() == 1
    assert engine.get(ids[0]).tier == "foreground" and engine.get(ids[0], ("user", "bob")) is None
    assert engine.memories().filter(F.col("id") == ids[0]).first().recall_count == 1
    assert {r.id for r in engine.recall("ALPHA_service", touch=False)} == set(ids[:2])
    assert engine.reindex()["cooccur_edges"] == 2
    assert engine.table("edges").count() == 2 and engine.connect([ids[0]], [ids[1]]).hops == 1
    got = engine.recall_planned("alpha_service gamma_cache", depth="Q2")
    assert {r.id for r in got["items"]} == set(ids[:2]) and engine.table("retrieval_runs").count() == 1 and got["stop_reason"] == "complete"
    assert engine.recall_planned("alpha_service", depth="Q0")["items"] == []
    assert engine.recall_planned("alpha_service", principal=("user", "bob"))["items"] == []
    engine.clock[0] += 2 * 86400
    assert [r.id for r in engine.due()] == [ids[0]]
    assert engine.grade(ids[0], 5).repetitions == 1
    assert engine.due() == [] and engine.review_stats().total == 1
    engine.enroll(ids[1], 3)
    assert engine.review_stats().due_in_7d == 2
    engine.clock[0] += 900 * 86400
    assert [r.id for r in engine.forget(threshold=0.2)] == [ids[2]]
    engine.forget(threshold=0.2, dry_run=False)
    assert {r.id for r in engine.table("memories").collect()} == set(ids[:2]) and engine.table("memory_cognitive").count() == 2
    assert [engine.forget_one(i) for i in ("no", ids[0])] == ["not_found", "protected"] and engine.forget_one(ids[0], force=True, dry_run=True) == "ok"
    engine.invalidate([ids[1]])
    assert engine.table("edges").count() == 0 and engine.recall("gamma", touch=False) == []
    assert engine.forget_one(ids[0], force=True) == "ok" and engine.table("memories").count() == 1


def test_stores_append_and_compaction_folds(engine):
    for i in range(3):
        engine.store({"kind": "episodic", "content": f"entry {i} about [[Topic]] and alpha_flag"})
    assert len(engine._parts("memories")) == 3 and engine.list_dangling()[0].mention_count == 3
    top = {r.name: r.mention_count for r in engine.list_concepts()}
    assert top["Topic"] == 3 and top["alpha_flag"] == 3
    (a, b, _) = [r.id for r in engine.table("memories").orderBy("content").collect()]
    engine.get(a)
    engine.get(a)
    engine.add_edge(a, b, 2.0)
    before = {r.id: (r.recall_count, round(r.connection_density, 4)) for r in engine.memories().collect()}
    assert before[a] == (2, 0.1386) and before[b] == (0, 0.1386)
    for name in ("memories", "concepts", "dangling_refs", "postings"):
        engine.compact(name)
    assert {r.id: (r.recall_count, round(r.connection_density, 4)) for r in engine.memories().collect()} == before
    assert engine.table("touches").count() == 0 and {r.name: r.mention_count for r in engine.list_concepts()} == top
    assert [r.id for r in engine.recall("entry 2", full_text=True, k=1, touch=False)] != []
    with pytest.raises(ValueError):
        engine.add_edge(a, a)
    assert engine.consolidate(threshold=3)["dangling_promoted"] == 1 and engine.consolidate(threshold=3, full_reindex=False)["dangling_promoted"] == 0


def test_inbox_is_idempotent_and_refuses_credentials(engine):
    assert engine.stage("k", "met Bob", domains=["a", "a"]) == engine.stage("k", "met Bob") and engine.table("inbox").count() == 1
    for bad in ("password: hunter2", "API key: sk-abcdefghijklmnopqrstuvwxyz123456"):
        with pytest.raises(ValueError):
            engine.stage("k2", bad)
    with pytest.raises(ValueError):
        engine.stage("k2", "fine", evidence=[{"locator": "secret = x"}])
    with pytest.raises(ValueError):
        engine.store_batch([])
    engine.clock[0] += 5
    engine.stage("k3", "later", source_id="s")
    assert [r.summary for r in engine.inbox_status()["items"]] == ["later", "met Bob"]
    assert engine.settle(source_id="s", memory_id="m", status="odd") == 1 and engine.inbox_status()["counts"] == {"staged": 1, "promoted": 1}
    assert [r.memory_id for r in engine.inbox_status("promoted")["items"]] == ["m"]
    with pytest.raises(KeyError):
        engine.settle("none")


def test_promotion_needs_evidence_parents_and_the_current_state(engine):
    governed(engine, "candidate", **dict.fromkeys(FIELDS, ""))
    denied = engine.promote("candidate")
    assert not denied["promoted"] and "complete_evidence_required" in denied["reasons"] and "source_required" in denied["reasons"]
    done = engine.promote("candidate", evidence=EVIDENCE[:1], run_id="night-1", **FIELDS)
    assert done["promoted"] and done["shared_state_version"] == 2
    side = engine.table("memory_cognitive").filter("memory_id = 'candidate'").first()
    assert (side.memory_tier, side.verification_status, side.review_status, side.evidence_count) == ("M1", "verified", "active", 1)
    assert engine.table("memory_evidence").first().locator == "turn://one" and engine.table("promotions").first().from_tier == "M0"
    for p in ("p1", "p2"):
        governed(engine, p, "M1", True, EVIDENCE[:1])
    assert engine.promote("candidate", "M2", ["p1"])["reasons"] == ["two_verified_M1_parents_required"]
    assert engine.promote("candidate", "M2", ["p1", "p2", "p1"], expected_version=2)["shared_state_version"] == 3
    assert engine.table("memory_lineage").filter("relation_type = 'summarizes'").count() == 2
    with pytest.raises(RuntimeError):
        engine.promote("candidate", "M3", expected_version=2)
    assert set(engine.promote("candidate", "M3")["reasons"]) == {"independent_adoption_required", "two_evidence_items_required"}
    with pytest.raises(KeyError):
        engine.promote("nobody")
    with pytest.raises(ValueError):
        engine.promote("candidate", "M0")


def test_activations_and_the_nightly_promotion(engine):
    for name, n in (("eligible", 3), ("often", 4), ("cold", 2)):
        governed(engine, name, "M2", True, EVIDENCE)
        for i in range(n):
            got = engine.activate(name, "adopted", f"turn://{i}", "2026-08-08" if i == 0 else "2026-08-09T10:00", f"s{i}")
            assert engine.activate(name, "adopted", f"turn://{i}", "2026-08-08" if i == 0 else "2026-08-09T10:00", f"s{i}")["deduplicated"]
        assert (got["activation_count"], got["distinct_dates"], got["distinct_sessions"]) == (n, 2, n)
    with pytest.raises(ValueError):
        engine.activate("cold", "seen", "x")
    with pytest.raises(ValueError):
        engine.activate("cold", "adopted", "x", "8 August")
    assert engine.promote_nightly(limit=1) == ["often"] and engine.promote_nightly() == ["eligible"] and engine.promote_nightly() == []
    assert {r.memory_id: r.memory_tier for r in engine.table("memory_cognitive").collect()} == {"eligible": "M3", "often": "M3", "cold": "M2"} and engine.version() == 3


def test_forged_attributes_are_ignored(engine):
    mid = engine.store({"kind": "semantic", "content": "ordinary", "meta": {"memory_tier": "M3", "verification_status": "verified", "owner_id": "alice", "visibility": "team", "acl": [{"id": "alice", "permission": "admin"}]}})
    side = engine.table("memory_cognitive").first()
    assert (side.memory_tier, side.verification_status, side.review_status, side.owner_id, side.visibility) == ("M0", "unreviewed", "quarantine", "jim", "private")
    assert [(r.principal_type, r.principal_id, r.permission) for r in engine.table("memory_acl").collect()] == [("user", "jim", "admin")] and engine.get(mid, ("user", "alice")) is None


def test_conflicts_and_supersession(engine):
    governed(engine, "old", "M1", True, EVIDENCE[:1])
    governed(engine, "new", "M1", True, EVIDENCE[:1], conflicts_with=["old"])
    (conflict,) = engine.table("memory_conflicts").collect()
    assert engine.review_conflict(conflict.conflict_id, "needs_more_evidence") == "open"
    assert {r.verification_status for r in engine.table("memory_cognitive").collect()} == {"conflicted"}
    assert engine.review_conflict(conflict.conflict_id, "resolved", "new", "review://x") == "resolved"
    assert {(r.verification_status, r.review_status) for r in engine.table("memory_cognitive").collect()} == {("verified", "active")}
    assert engine.supersede("old", "new", "review://approved") == 2
    old = engine.table("memories").filter("id = 'old'").first()
    sides = {r.memory_id: r for r in engine.table("memory_cognitive").collect()}
    assert old.invalid_at is not None and old.superseded_by == "new" and sides["old"].review_status == "retired" and sides["new"].supersedes_memory_id == "old"
    assert [tuple(r) for r in engine.table("edges").collect()] == [("new", "old", 1.0, "supersede")] and engine.table("memory_lineage").filter("relation_type = 'supersedes'").count() == 1
    with pytest.raises(RuntimeError):
        engine.supersede("old", "new", "again")
    with pytest.raises(RuntimeError):
        engine.supersede_unchecked("old", "new")


def test_dreams_are_idempotent_capped_and_rerank(engine):
    governed(engine, "dreamed", "M1", True, EVIDENCE)
    governed(engine, "plain", "M1", True, EVIDENCE)
    governed(engine, "unstable")
    got = engine.dream("d0", "2023-11-14", [("dreamed", 3, 3), ("unstable", 1, 1), ("nobody", 1, 1)])
    assert got["accepted"][0]["base_delta"] == 0.035 and not got["accepted"][0]["deduplicated"]
    assert got["rejected"] == [{"memory_id": "unstable", "reason": "stable_tier_required"}, {"memory_id": "nobody", "reason": "acl_denied"}]
    assert engine.dream("d0", "2023-11-14", [("dreamed", 3, 3)])["accepted"][0]["deduplicated"] and engine.table("dream_events").count() == 1
    for i in range(5):
        engine.dream(f"d{i + 1}", "2023-11-14", [("dreamed", 3, 3)])
    assert engine.dream_effect("2023-11-14").first().dream == pytest.approx(0.12) and engine.dream_effect("2023-12-14").first().dream == pytest.approx(0.105, abs=0.002)
    with pytest.raises(ValueError):
        engine.dream("d", "14.11.2023", [])
    vec = [1.0] + [0.0] * 15
    engine.replace("memories_vec", engine.spark.createDataFrame([("dreamed", vec), ("plain", vec)], "memory_id string, vec array<float>"))
    on, off = (engine.recall_planned("governed memory", vector=vec, dreams=x, touch=False)["items"] for x in (True, False))
    assert on[0].id == "dreamed" and "梦境可达性" in on[0].why_recalled and on[0].dream_boost > 0 and all(r.dream_boost == 0 for r in off)
    assert {r.id for r in engine.dream_seeds("s", 4)} == {"dreamed", "plain"} and engine.dream_seeds("s", 4) == engine.dream_seeds("s", 4) and engine.dream_seeds("s", 4, principal=("user", "eve")) == []
    assert engine.dream_seeds("s", 1)[0].reinforced


def test_planned_recall_packs_budgets_audit_and_deadline(engine):
    governed(engine, "fact", "M1", True, EVIDENCE, domains=["Work"], root_source_id="root:1")
    engine.store_batch([{"id": "book", "kind": "knowledge_book", "content": "governed memory in a book"}, {"id": "long", "kind": "semantic", "content": "governed memory " + "长" * 500}])
    engine.store({"id": "hers", "kind": "semantic", "content": "governed memory of hers"}, principal=("user", "eve"))
    got = engine.recall_planned("governed memory", depth="Q2", domains=["work"], touch=False)
    assert [r.id for r in got["items"]][0] == "fact" and {r.id for r in got["items"]} == {"fact", "long"} and "领域:work" in got["items"][0].why_recalled
    assert got["citation_pack"][0] == {"memory_id": "fact", "source_id": "test:fact", "root_source_id": "root:1", "locators": ["review://two", "turn://one"]} and len(got["evidence_pack"][0]["evidence"]) == 2
    assert {r.id: (r.permission_result, r.filter_reason) for r in got["audit"]}["hers"] == ("denied", "acl_denied")
    assert {r.id for r in engine.recall_planned("governed memory", depth="Q3", touch=False)["items"]} == {"fact", "long", "book"}
    tight = engine.recall_planned("长长长", depth="Q1", token_budget=100, max_chars=30)
    assert tight["tokens"] == 30 and len(tight["items"][0].snippet) == 30 and engine.memories().filter("id = 'long'").first().recall_count == 1
    engine.fold_seen()
    side = engine.sidecars().filter("memory_id = 'long'").first()
    assert (side.seen_count, side.activation_count) == (3, 0)
    began = time.time()
    late = engine.recall_planned("governed memory", timeout_ms=1)
    assert late["partial"] and late["stop_reason"] == "timeout" and time.time() - began < 20
    assert engine.stats()["tiers"] == {"M1": 1, "M0": 3} and engine.stats()["open_conflicts"] == 0
    assert engine.ready()["status"] == "degraded" and engine.warm_up()["status"] == "ready"


def test_hybrid_connections_digest_and_bundles(engine):
    engine.store_batch([{"id": f"m{i}", "kind": "episodic", "content": t} for i, t in enumerate(["profit alpha_term rules", "profit alpha_term with beta_term stock", "stock beta_term classes", "weather is fine today"])])
    engine.backfill_vectors()
    engine.add_edge("m0", "m1", 2.0)
    engine.add_edge("m1", "m2", 2.0)
    path = engine.connect_queries("rules", "classes", hops=3)
    assert (path.hops, path.path, path.connector) == (2, ["m0", "m1", "m2"], "m1") and path.snippets[0].startswith("profit")
    got = engine.recall_hybrid("profit alpha_term", k=3)
    assert any("字面" in r.via for r in got) and all(("字面" in r.via) == (r.id in ("m0", "m1")) for r in got) and engine.memories().agg(F.sum("recall_count")).first()[0] == 3
    both = engine.connect_ranked("rules", "classes", personal=False)
    assert both["connected"] and both["method"] == "ppr" and {i for i, _ in both["connectors"]} & {"m1", "m2"}
    digest = engine.digest()
    assert digest["counts"]["memories"] == 4 and len(digest["top"]) == 4 and len(engine.digest(project="profit")["top"]) > 0
    bundle = "mb-" + "a" * 12
    engine.store_batch([{"kind": "semantic", "content": '{"content": "part two"}', "meta": {"bundle_id": bundle, "chunk_index": 2}}, {"kind": "semantic", "content": "part one, ", "meta": {"bundle_id": bundle, "chunk_index": 1}}])
    assert engine.bundle(bundle)["content"] == "part one, part two" and engine.bundle(bundle, ("user", "eve")) is None and engine.bundle("mb-" + "b" * 12) is None
    with pytest.raises(ValueError):
        engine.bundle("mb-XYZ")


def test_jobs_to_the_end(engine, tmp_path):
    engine.store_batch([{"id": f"e{i}", "kind": "episodic", "content": f"deploy failed because cache_key {w}", "importance": 4} for i, w in enumerate(["expired", "vanished"])])
    vec = [1.0] + [0.0] * 15
    engine.replace("memories_vec", engine.spark.createDataFrame([("e0", vec), ("e1", [0.8, 0.6] + [0.0] * 14)], "memory_id string, vec array<float>"))
    assert engine.relate(lambda a, b: {"rel": "supports", "because": "same cache"}) == 1 and engine.relate(lambda a, b: {"rel": "supports"}) == 0
    assert [r.because for r in engine.relations("same cache")] == ["same cache"]
    assert engine.distill(lambda texts: {"title": "Caches", "insight": f"{len(texts)} failures", "worth": "yes"}) == 1
    note = engine.table("memories").filter("kind = 'semantic'").first()
    assert note.content == "Caches\n2 failures" and engine.table("edges").filter("kind = 'provenance' AND weight = 3.0").count() == 4
    assert engine.distill(lambda texts: {"title": "again", "insight": "x"}) == 0
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.md").write_text("---\nname: Rule\ntype: feedback\n---\nalways check the cache_key\n")
    files = markdown(engine.spark, str(tmp_path / "files"))
    assert engine.sync_files(files) == {"added": 1, "updated": 0} and engine.sync_files(files) == {"added": 0, "updated": 0}
    (tmp_path / "files" / "a.md").write_text("---\nname: Rule\ntype: feedback\n---\nnever mind\n")
    assert engine.sync_files(markdown(engine.spark, str(tmp_path / "files"))) == {"added": 0, "updated": 1} and engine.table("memories").filter("kind = 'procedural'").first().content == "never mind"
    assert engine.back_up("e0", "key", J.Pools({"gist": lambda name, data: name})) == 4 and '"e0"' in engine.restore("e0", "key").record and engine.restore("e1", "key") is None
    receipt = engine.nightly(vault=str(tmp_path / "vault"), full_reindex=True)
    assert receipt["status"] == "ok", receipt
    assert [s["step"] for s in receipt["steps"]][:3] == ["file_sync", "distill", "consolidate"] and (tmp_path / "vault" / "README.md").exists()
    assert engine.constitution().startswith("# 宪法") and engine.propose("x")["status"] == "queued_for_human_review"
    assert engine.backfill_governance() == {"processed": 0, "complete": True}


def test_counts_of_what_was_seen_only_grow(engine):
    engine.store_batch([{"id": i, "kind": "semantic", "content": "x"} for i in ("a", "b")])
    seen = lambda: {r.memory_id: r.seen_count for r in engine.sidecars().collect()}
    show = lambda run, *ids: engine.append("run_items", engine._rows("run_items", [(run, i, 1, None, None, 0.0, "allowed", "", k + 1, engine.now()) for k, i in enumerate(ids)]))
    show("r1", "a", "b")
    show("r2", "a")
    engine.fold_seen()
    engine.fold_seen()
    show("r2", "a")  # delivered again
    engine.fold_seen()
    assert seen() == {"a": 2, "b": 1}
    engine.clock[0] += 40 * 86400
    show("r3", "a")
    engine.fold_seen()
    engine.compact("seen")
    engine.fold_seen()
    assert engine.table("run_items").count() == 1 and seen() == {"a": 3, "b": 1} and engine.table("seen").filter("batch = ''").count() == 2


def test_equal_memories_of_one_second_are_two(engine):
    ids = [engine.store({"kind": "semantic", "content": "same"}) for _ in range(2)]
    assert len(set(ids)) == 2 and engine.table("memories").count() == 2
    again = [engine.store({"kind": "semantic", "content": "same", "source_id": "s"}) for _ in range(2)]
    assert len(set(again)) == 1 and engine.table("memories").count() == 3


def test_a_slow_channel_leaves_the_others_results(engine, monkeypatch):
    from loamstone.operators import fulltext as T

    governed(engine, "fact", "M1", True, EVIDENCE)
    vec = [1.0] + [0.0] * 15
    engine.replace("memories_vec", engine.spark.createDataFrame([("fact", vec)], "memory_id string, vec array<float>"))
    engine.recall_planned("governed memory", vector=vec, touch=False)  # warm

    def slow(rows, *args, **kwargs):
        spark = engine.spark
        wait = spark.range(1).mapInPandas(lambda parts: (time.sleep(300) or p for p in parts), "id long")
        return wait.select(F.col("id").cast("string"), F.lit(1.0).alias("fused"), F.lit(1.0).alias("bm25"), F.lit(1).alias("best_rank"))

    monkeypatch.setattr(T, "search_bounded", slow)
    began = time.time()
    got = engine.recall_planned("governed memory", vector=vec, timeout_ms=60_000, touch=False)
    assert time.time() - began < 60
    assert [r.id for r in got["items"]] == ["fact"] and got["items"][0].via == "vector"
    assert got["partial"] and got["stop_reason"] == "timeout" and got["late"] == ["lexical"]
    assert not [j for j in engine.spark.sparkContext.statusTracker().getActiveJobsIds()]
    began = time.time()
    none = engine.recall_planned("governed memory", vector=[0.0] * 16, depth="Q1", timeout_ms=10_000, touch=False)
    assert none["partial"] and none["stop_reason"] == "timeout" and time.time() - began < 12
