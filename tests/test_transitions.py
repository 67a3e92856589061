"""Governance, search, registration and nightly jobs on small inputs, with expected values worked out by hand or by brute force."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import fulltext as T
from loamstone.operators import governance as G
from loamstone.operators import graph as N
from loamstone.operators import jobs as J
from loamstone.operators import register as Q

NOW = 1706745600


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_conflicts_and_supersede(spark):
    c = spark.createDataFrame([("k", "a", "b", "open"), ("l", "b", "z", "open"), ("m", "a", "z", "dismissed")], "conflict_id string, left_memory_id string, right_memory_id string, status string")
    told = lambda *x: {r.conflict_id: r.status for r in G.reviewed(c, *x).collect()}
    assert told("k", "resolved", "a", "loc") == {"k": "resolved", "l": "open", "m": "dismissed"} and told("k", "needs_more_evidence")["k"] == "open" and told("m", "needs_more_evidence")["m"] == "open"
    for bad, error in ((("k", "resolved"), ValueError), (("k", "resolved", "a"), ValueError), (("k", "maybe", "a", "x"), ValueError), (("no", "dismissed"), KeyError), (("m", "dismissed"), RuntimeError)):
        with pytest.raises(error):
            G.reviewed(c, *bad)
    side = spark.createDataFrame([(i, "M1", "conflicted", "needs_review") for i in "abz"], "memory_id string, memory_tier string, verification_status string, review_status string")
    sides = spark.createDataFrame([("a",), ("b",)], "memory_id string")
    after = {r.memory_id: (r.verification_status, r.review_status) for r in G.relabelled(side, G.reviewed(c, "k", "resolved", "a", "loc"), sides).collect()}
    assert after == {"a": ("verified", "active"), "b": ("conflicted", "needs_review"), "z": ("conflicted", "needs_review")}
    side = spark.createDataFrame([("a", "M1", "verified", "active", None), ("b", "M0", "verified", "active", None)], "memory_id string, memory_tier string, verification_status string, review_status string, supersedes_memory_id string")
    mem = spark.createDataFrame([("a", None, None), ("b", None, None)], "id string, invalid_at long, superseded_by string")
    m, s, x = G.superseded(mem, side, c, "b", "a", 9)
    assert {r.id: (r.invalid_at, r.superseded_by) for r in m.collect()} == {"a": (None, None), "b": (9, "a")}
    assert {r.memory_id: (r.review_status, r.supersedes_memory_id) for r in s.collect()} == {"a": ("active", "b"), "b": ("retired", None)}
    assert {r.conflict_id: r.status for r in x.collect()} == {"k": "resolved", "l": "resolved", "m": "dismissed"}
    for old, new, error in (("a", "b", RuntimeError), ("a", "a", ValueError), ("q", "a", KeyError)):
        with pytest.raises(error):
            G.superseded(mem, side, c, old, new, 9)


def test_trigram_search(spark):
    rows = spark.createDataFrame([("a", "今天我们讨论项目进度管理", 1), ("b", "complicated ALPHA alphalpha", 2), ("c", "beta planning", 3), ("d", None, 4), ("e", "xx ab", 5), ("f", "ABab 项目", 6)], "id string, content string, last_recall_ts long")
    find = lambda q, **k: [r.id for r in T.search(rows, X.query_terms(q), **k).collect()]
    assert find("项目进度") == ["a"] and find("LICAT") == ["b"] and find("ab") == [] and find("") == []
    assert {(r.id, r.phrase): r.tf for r in T.hits(rows, ["alpha", "lan"]).collect()} == {("b", 0): 3, ("c", 1): 1}
    n, df, tf, dl = 6, 1, 3, len("complicated ALPHA alphalpha") - 2
    avg = sum(max(0, len(t) - 2) for t in ("今天我们讨论项目进度管理", "complicated ALPHA alphalpha", "beta planning", "", "xx ab", "ABab 项目")) / 6
    want = math.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert T.search(rows, ["alpha"]).first().bm25 == pytest.approx(want)
    index = (T.postings(rows), T.statistics(rows))
    for q in ("项目进度", "alpha planning", "ab", "zzz", "alphalp"):
        assert find(q, index=index) == find(q)
    assert [(r.id, r.position) for r in T.entries(rows, "ab", X.query_terms("ab")).collect()] == [("f", 1), ("e", 2), ("b", 3)][:2]
    texts = spark.createDataFrame([("strong", "alpha project alpha project alpha"), ("beta", "beta planning details"), ("noise", "unrelated material")], "id string, content string")
    assert [r.id for r in T.search_bounded(texts, X.query_terms("alpha beta"), 3, 12).collect()] == ["strong", "beta"]


def test_attributes_are_registered(spark):
    meta = {"domains": ["工作", "供应链", " "], "entities": [{"name": "样品"}, {"id": "X9"}], "tags": "a,b", "scope": "Proj", "evidence": {"type": "note", "url": "u1", "statement": "s", "observed_at": "2024"}, "owner_id": "eve", "verified": "是", "memory_tier": "m2",
        "acl": [{"id": "bob"}, {"id": "x", "permission": "own"}], "conflicts_with": ["m2", "m1"], "parent_memory_id": "p", "confidence": 0}
    rows = spark.createDataFrame([("m1", "book", "mode", json.dumps(meta, ensure_ascii=False)), ("m2", "decision", "mode", None)], "id string, kind string, mode_id string, meta string")
    plain, trusted = (Q.registered(rows, ("User", "ann"), 5, t) for t in (False, True))
    side = {t: {r.memory_id: r for r in x["memory_cognitive"].collect()} for t, x in (("plain", plain), ("trusted", trusted))}
    a, b = side["plain"]["m1"], side["trusted"]["m1"]
    assert (a.memory_tier, a.verification_status, a.review_status, a.owner_type, a.owner_id, a.visibility) == ("M0", "unreviewed", "quarantine", "user", "ann", "private")
    assert (a.lifecycle_stage, a.confidence, a.evidence_count, a.scope, a.parent_memory_id) == ("deep", 0.7, 1, "Proj", "")
    assert (b.memory_tier, b.verification_status, b.review_status, b.owner_id, b.last_verified_ts) == ("M2", "verified", "active", "eve", 5)
    assert (side["plain"]["m2"].memory_form, side["plain"]["m2"].scope, side["plain"]["m2"].root_source_id) == ("procedural", "mode", "m2")
    assert {(r.facet_type, r.facet_value) for r in plain["memory_facets"].collect()} == {("domain", "工作"), ("domain", "供应链"), ("entity", "样品"), ("entity", "x9"), ("tag", "a"), ("tag", "b"), ("project", "proj")}
    assert {tuple(r)[1:4] for r in plain["memory_acl"].filter("memory_id = 'm1'").collect()} == {("user", "ann", "admin")}
    assert {tuple(r)[1:4] for r in trusted["memory_acl"].filter("memory_id = 'm1'").collect()} == {("user", "eve", "admin"), ("user", "bob", "read")}
    assert [tuple(r) for r in plain["memory_evidence"].collect()] == [("m1", "note", "u1", "s", "2024")]
    assert [tuple(r) for r in trusted["memory_lineage"].collect()] == [("m1", "p", "derived_from")] and plain["memory_lineage"].count() == 0
    (x,) = plain["memory_conflicts"].collect()
    assert x.conflict_id == "conf-" + hashlib.sha256(b"m1|m2").hexdigest()[:16] and x.status == "open"


def test_values_of_json_dates_and_bigrams(spark):
    assert one(spark, X.iso_date(F.lit("2024-02-29T10:00"))).isoformat() == "2024-02-29" and one(spark, X.iso_date(F.lit("2024-2-1"))) is None and one(spark, X.iso_date(F.lit("2024-13-01"))) is None
    assert one(spark, X.parsed_json(F.lit("[1, 2]"), "array<int>", F.array(F.lit(0)))) == [1, 2] and one(spark, X.parsed_json(F.lit(None).cast("string"), "array<int>", F.array(F.lit(0)))) == [0]
    assert one(spark, X.bigram_similarity(F.lit("样品 发货"), F.lit("样品发"))) == pytest.approx(2 / math.sqrt(6)) and one(spark, X.bigram_similarity(F.lit("a"), F.lit("ab"))) == 0
    assert one(spark, S.normalized(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8]) and one(spark, S.normalized(F.array(F.lit(0.0)))) == [0.0]
    assert X.segmented("x", lambda t: ["我们", "项目", "进", "ab"]) == ["项目"]


def test_clusters_and_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vec = rng.standard_normal((60, 3))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    rows = [(f"m{i:02d}", int(rng.integers(0, 40)), [float(x) for x in v]) for i, v in enumerate(vec)]
    leaders, want = [], {}
    for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0]))[:40]:
        want[i] = next((name for name, u in leaders if float(np.dot(u, v)) > 0.7), None)
        if want[i] is None:
            leaders.append((i, v))
            want[i] = i
    df = spark.createDataFrame(rows, "id string, created_ts long, vec array<double>")
    assert {r.id: r.leader for r in J.clusters(df, 0.7).collect()} == want and 1 < len(set(want.values())) < 40
    texts = spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(50)], "id string, content string")
    got = {r.memory_id: r.vec for r in J.embedded(texts, dim=16).collect()}
    assert all(np.allclose(got[f"t{i}"], J.hash_embedding([f"text {i}"], 16)[0], atol=1e-6) for i in range(50))

    def half(batch, dim):
        if "text 3" in batch:
            raise OSError("down")
        return J.hash_embedding(batch, dim)

    left = {r.memory_id for r in J.embedded(texts.coalesce(1), half, 16, batch=10).collect()}
    assert left == {f"t{i}" for i in range(10, 50)}


def test_pools_settings_and_labels(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 5, NOW, "semantic")], "id string, content string, importance int, created_ts long, kind string")

    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return name

    def down(name, data):
        raise OSError("down")

    placed = J.Pools({"gist": put, "webdav": down}).placed(J.replicas(rows, "k", NOW))
    placed = spark.createDataFrame(placed.collect(), placed.schema)
    assert {r.pool: r.pending_upload for r in placed.collect()} == {"gist": False, **dict.fromkeys(J.POOLS[1:], True)} and (tmp_path / "sh-a-0").exists()
    assert {r.pool for r in J.Pools({"webdav": put}).retried(placed).filter("pending_upload").collect()} == set(J.POOLS[2:])
    assert J.merged_config({"a": "1", "b": "2"}, {"a": "", "b": "3"}) == {"a": "1", "b": "3"} and J.setting("a", {"a": ""}, {"a": "env"}) == "env"
    said = {("x", "y"): {"rel": "causes", "because": "so", "direction": "b_to_a"}, ("x", "z"): {"rel": "none"}, ("y", "z"): None}
    (row,) = J.labelled([("1", "2", "x", "y"), ("1", "3", "x", "z"), ("2", "3", "y", "z")], lambda a, b: said[a, b], lambda t: [1.0], 7)
    assert row[1:5] == ("2", "1", "causes", "so") and row[6] == [1.0]
    marked = J.consolidated(spark.createDataFrame([("a", '{"k": 1}'), ("b", None), ("c", "{}")], "id string, meta string"), ["a", "b"], "n")
    assert {r.id: json.loads(r.meta) for r in marked.collect()} == {"a": {"k": 1, "consolidated": True, "consolidated_into": "n"}, "b": {"consolidated": True, "consolidated_into": "n"}, "c": {}}


def test_vault_files(spark, tmp_path):
    edges = spark.createDataFrame([(a, b, 1.0) for a in "abcdefgh" for b in "abcdefgh" if a != b], "src string, dst string, weight double")
    found = spark.createDataFrame([(c, f"N/{c}" if c > "b" else "same", 2, 3, False) for c in "abcdefg"] + [("h", "hub", 9, 9, True)], "concept_id string, name string, mention_count long, doc_freq long, is_hub boolean")
    members = spark.createDataFrame([("m1", "a"), ("m2", "a")], "memory_id string, concept_id string")
    memories = spark.createDataFrame([("m1", 1, "first\nmore"), ("m2", 5, "second")], "id string, importance int, content string")
    maps = {r.name: r.content for r in N.concept_maps(edges, members, memories, found).collect()}
    assert "hub" not in maps and maps["same"].startswith("# 概念地图: same\n\n关联概念: [[")
    notes = N.concept_notes(edges, members, memories, found)
    assert {r.name for r in notes.collect()} == {"same", "same_b", *[f"N{c}" for c in "cdefg"]}
    done = J.write_vault(notes, spark.createDataFrame([("map", "# m\nx")], "name string, content string"), str(tmp_path / "vault"))
    assert done == {"concept_notes": 7, "moc_notes": 1}
    text = (tmp_path / "vault" / "concepts" / "same.md").read_text()
    assert "- second\n- first" in text and (tmp_path / "vault" / "moc" / "map.md").read_text() == "# m\nx\n" and (tmp_path / "vault" / "README.md").exists()
    assert sorted(r.concept for r in N.themes(edges, found).collect()) == ["N/c", "N/d", "N/e", "N/f", "same", "same"]


def test_postings_take_time_linear_in_the_text(spark):
    import time

    from pyspark.sql import functions as F

    def took(kb):
        texts = spark.range(8, numPartitions=1).select(F.col("id").cast("string"), F.expr(f"array_join(transform(sequence(1, {kb} * 128), i -> substring(sha2(cast(i as string), 256), 1, 8)), '')").alias("content")).cache()
        texts.count()
        began = time.perf_counter()
        n = T.postings(texts).count()
        assert n == 8 * (kb * 1024 - 2)
        return time.perf_counter() - began

    took(10)
    base, twice, four = (min(took(kb) for _ in range(3)) for kb in (10, 20, 40))
    assert four < 9 * base + 0.2 and twice < 5 * base + 0.2


def test_phrases_are_found_by_their_places_alone(spark, tmp_path):
    import random

    r = random.Random(4)
    made = ["".join(r.choice("abé项 ") for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "aaaaaaaaaa", "ab" * 30]
    rows = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(made)], "id string, content string")
    T.write_index(rows, str(tmp_path / "index"))
    index = T.read_index(spark, str(tmp_path / "index"))
    phrases = ["aaa", "aaaa", "ababab", "abababab", "项 a", "é项éa", "zzzz", "ab", "bé a"]
    places = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = {(f"m{i}", k): (len(t) - 2, places(t, p)) for i, t in enumerate(made) if t for k, p in enumerate(phrases) if len(p) > 2 and places(t, p)}
    assert {(x.id, x.phrase): (x.dl, x.tf) for x in T.indexed_hits(index[0], phrases).collect()} == want
    assert T.indexed_hits(index[0], ["ab"]).collect() == []
    near = lambda df: {x.id: round(x.bm25, 9) for x in df.collect()}
    assert near(T.search(None, phrases, 500, index)) == near(T.search(rows, phrases, 500))
    assert near(T.search(rows.limit(0), phrases, 500, index)) == {}
    plan = T.search(None, phrases, 5, index)._jdf.queryExecution().toString()
    assert "content" not in plan


def test_a_stored_index_has_a_row_a_trigram_of_a_block(spark, tmp_path, monkeypatch):
    import random

    r = random.Random(6)
    texts = ["".join(r.choice("abcé項\U0001f600 ") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["xyabc", "defgh", "abcabcabc" * 40, None, "ab"]
    rows = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "id string, content string").coalesce(1)
    phrases = ["abcdef", "abc", "cabca", "\U0001f600a", "a\U0001f600b", "é項a", "bcabc a"]
    places = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = {(f"m{i}", k, len(t) - 2, places(t, p)) for i, t in enumerate(texts) if t for k, p in enumerate(phrases) if len(p) > 2 and places(t, p)}
    for block, path in ((1 << 22, "one"), (500, "many")):
        monkeypatch.setattr(T, "BLOCK", block)
        T.write_index(rows, str(tmp_path / path))
        table, _ = T.read_index(spark, str(tmp_path / path))
        assert {(x.id, x.phrase, x.dl, x.tf) for x in T.indexed_hits(table, phrases).collect()} == want
        grams = {t[i : i + 3] for t in texts if t for i in range(len(t) - 2)}
        if block > 500:  # before, a row for each place
            assert table.count() == len(grams) + 1
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 31) - 1])
    data, off = T.varints(values, np.array([0, 4]))
    assert T.from_varints(data.tobytes()).tolist() == values.tolist() and T.from_varints(data[off[1] :].tobytes()).tolist() == values[4:].tolist()
