import random
import time

import pytest

from loamstone.engine import Engine
from loamstone.operators import concept_deltas as D
from loamstone.operators import graph as N
from loamstone.operators import memory as M
from loamstone.operators import segment as W

SCHEMA = "id string, kind string, content string, invalid_at long"


def notes(n, seed=3):
    """Memories whose names become hubs, outgrow the largest bucket and cease being hubs as others come; copies, maps, invalid ones."""
    r = random.Random(seed)
    ids = [f"m{i:04d}" for i in range(n)]
    r.shuffle(ids)
    rows = []
    for k, i in enumerate(ids):
        names = [f"name_{r.randint(0, 40)}" for _ in range(r.randint(0, 5))] + (["early_hub"] if k < 25 else []) + (["growing"] if k % 3 == 0 else []) + ["Rare_Case" if k % 2 else "rare_case"] * (k % 40 == 7)
        text = " ".join(names) + (f" [[Linked {k % 9}]]" if k % 4 == 0 else "") + ("" if k % 5 else f" {k}")
        rows.append((i, "moc" if k % 31 == 30 else "semantic", rows[r.randrange(len(rows))][2] if k % 11 == 10 else text, 1 if k % 37 == 36 else None))
    return rows


def as_set(df):
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_differences_equal_a_full_index(spark):
    rows = notes(240)
    whole = N.representatives(spark.createDataFrame(rows, SCHEMA))
    found_links = N.stored_links(whole)
    found = N.concepts(found_links, whole.count())
    told = N.telling(found_links, found)
    logs, at = None, 0
    for size in (1, 23, 60, 3, 100, 53):
        batch = spark.createDataFrame(rows[at : at + size], SCHEMA)
        at += size
        logs = D.begun(batch) if logs is None else D.added(logs, D.advance(logs, batch))
    assert at == len(rows)
    assert as_set(D.concepts(logs)) == as_set(found.select("concept_id", "name", "kind", "mention_count", "doc_freq", "is_hub"))
    assert as_set(D.links(logs).select("memory_id", "concept_id")) == as_set(found_links.select("memory_id", "concept_id"))
    pairs = as_set(N.pair_weights(told))
    assert pairs and as_set(D.memory_pairs(logs)) == pairs
    assert as_set(D.concept_pairs(logs)) == as_set(N.pair_weights(told, "concept_id", "memory_id"))
    assert as_set(N.cooccurrence_edges(D.memory_pairs(logs))) == as_set(N.cooccurrence_edges(N.pair_weights(told)))
    hubs = {r.name for r in found.filter("is_hub").collect()}
    assert "growing" in hubs and "early_hub" not in {r.name for r in found.filter("doc_freq <= 12 AND is_hub").collect()}


def test_engine_follows_its_stores_behind_readers(spark, tmp_path):
    clock = [1_700_000_000]
    a, b = (Engine(spark, str(tmp_path / n), lambda: clock[0]) for n in "ab")
    rows = [{"id": i, "kind": "semantic", "content": t} for i, k, t, gone in notes(60, 5) if k != "moc" and not gone]
    for e in (a, b):
        e.store_batch(rows[:30])
    assert a.refresh_graph(wait=True) and not a.refresh_graph()
    reader = a.table("edges")
    before = as_set(reader.select("src", "dst", "weight"))
    for e in (a, b):
        e.store_batch(rows[30:])
    assert not a.refresh_graph()  # a minute isn't over
    clock[0] += 61
    assert a.refresh_graph(wait=True)
    assert before and as_set(reader.select("src", "dst", "weight")) == before
    b.reindex()
    for name in ("edges", "concept_edges", "concepts", "mem_concepts"):
        assert as_set(a.table(name).select(*b.table(name).columns)) == as_set(b.table(name)), name
    assert as_set(a.memories().select("id", "connection_density")) == as_set(b.memories().select("id", "connection_density"))
    assert as_set(a.table("edges").select("src", "dst", "weight")) != before and a.advance_graph() == 0
    for e in (a, b):
        e.delete([rows[0]["id"], rows[31]["id"]])
    a.advance_graph()
    b.reindex()
    assert as_set(a.table("concepts").select(*b.table("concepts").columns)) == as_set(b.table("concepts")) and as_set(a.table("edges")) == as_set(b.table("edges"))


def every_cut(run):
    if not run:
        yield []
    for n in range(1, min(W.LONGEST, len(run)) + 1):
        for rest in every_cut(run[n:]):
            yield [run[:n], *rest]


def test_best_cut_is_the_best_of_all(spark):
    r = random.Random(2)
    words = ["项目", "进度", "管理", "我们", "讨论", "目进", "度管理", "样", "品"]
    texts = ["".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60)] + ["plain", None, "项a目", "a" * 50]
    rows = spark.createDataFrame([(f"m{i}", "semantic", t, None) for i, t in enumerate(texts)], SCHEMA)
    cost = W.costs(W.word_counts(rows))
    assert cost["项目"] < cost[""] and {len(w) for w in cost} == {0, 1, 2, 3, 4}
    counts = {w: sum((t or "").startswith(w, i) for t in texts for i in range(len(t or ""))) for w in cost if w}
    assert all(n >= 2 for n in counts.values()) and {x.word: x.c for x in W.word_counts(rows).collect()} == counts
    price = lambda cut: sum(cost.get(w, cost[""] if len(w) == 1 else 1e9) for w in cut)
    for t in {t for t in texts if t and len(t) <= 9}:
        run = "".join(c for c in t if "一" <= c <= "龥")
        got = W.best_cut(run, cost)
        best = min(((round(price(c), 7), len(c)) for c in every_cut(run)), default=(0.0, 0))
        assert "".join(got) == run and (round(price(got), 7), len(got)) == best
    links = N.concept_links(N.representatives(rows), cost)
    names = {x.name for x in links.collect()} - {"plain", "a" * 50}
    assert names >= {"管理"} and all(2 <= len(n) <= W.LONGEST and n in cost for n in names)


def test_many_ranks_equal_single_ones(spark):
    r = random.Random(4)
    edges = spark.createDataFrame([(f"n{r.randint(0, 40)}", f"n{r.randint(0, 40)}", float(r.randint(1, 5))) for _ in range(160)], "src string, dst string, weight double").dropDuplicates(["src", "dst"])
    seeds = [("a'b", "n1", 2.0), ("a'b", "n2", 1.0), ("q", "n7", 1.0), ("z", "nowhere", 1.0)]
    got = {(x.query, x.id): x.r for x in N.ranked_many(edges, spark.createDataFrame(seeds, "query string, id string, weight double"), block=2).collect()}
    want = {}
    for q in ("a'b", "q", "z"):
        own = spark.createDataFrame([(i, w) for name, i, w in seeds if name == q], "id string, weight double")
        want |= {(q, x.id): x.r for x in N.ranked(edges, own).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert N.ranked_many(edges, spark.createDataFrame([], "query string, id string, weight double")).count() == 0


def test_vector_index_finds_what_a_scan_finds(spark, tmp_path):
    import numpy as np

    from loamstone.operators import vector_index as V

    r = np.random.default_rng(3)
    centers = r.standard_normal((30, 24))
    x = centers[r.integers(0, 30, 3000)] + 0.5 * r.standard_normal((3000, 24))
    rows = [(f"m{i}", [float(v) for v in u]) for i, u in enumerate(x)] + [("short", [1.0, 2.0]), ("none", None)]
    vectors = spark.createDataFrame(rows, "memory_id string, vec array<float>").repartition(4)
    queries = vectors.filter("memory_id LIKE 'm%00'").select(vectors.memory_id.alias("query"), "vec")
    exact = V.nearest_many(vectors, queries, 10)
    first = {q: [m for *_, m in sorted((-round(float(np.float32(x[int(q[1:])]).astype(float) / np.linalg.norm(np.float32(x[int(q[1:])]).astype(float)) @ np.float32(u).astype(float)), 9), f"m{i}") for i, u in enumerate(x))[:10]] for q in ("m100", "m2300")}
    got = {}
    for e in exact.orderBy("query", "rank").collect():
        got.setdefault(e["query"], []).append(e.memory_id)
    assert len(got) == 29 and all(got[q] == first[q] for q in first)
    path = str(tmp_path / "index")
    V.write_lists(vectors, V.fitted_centroids(vectors, 24, sample=1000), path)
    assert spark.read.parquet(f"{path}/lists").count() == 3000
    some = V.search_lists(spark, path, queries, 10, 6)
    assert "PartitionFilters: [isnotnull(list" in some._jdf.queryExecution().toString() or "list" in some._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]
    assert V.recall(some, exact).agg({"recall": "avg"}).first()[0] >= 0.9
    assert as_set(V.search_lists(spark, path, queries, 10, 24)) == as_set(exact)
    assert V.nearest_many(vectors, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("limit", [0.2])
def test_a_cold_index_is_not_waited_for(spark, tmp_path, limit):
    e = Engine(spark, str(tmp_path / "db"), lambda: 1, embed=lambda texts, dim: [[1.0] + [0.0] * (dim - 1)] * len(texts), dim=4)
    e.replace("memories_vec", spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "memory_id string, vec array<float>"))
    assert e.search_vectors("x", 1, warm_only=True) == []
    e.warming.join()
    assert [r.memory_id for r in e.search_vectors("x", 1, warm_only=True)] == ["a"]
    e.build_vector_index(2)
    assert [r.memory_id for r in e.search_vectors("x", 2)] == ["a", "b"]
    slow = Engine(spark, str(tmp_path / "db"), lambda: 1, embed=lambda texts, dim: time.sleep(30), dim=4)
    began = time.time()
    assert slow.search_vectors("x", 1, timeout_ms=1000 * limit) is None and time.time() - began < 10


def test_rounds_move_ranks_between_sources_alone(spark, monkeypatch):
    """Edges to targets without edges of their own take part in the last round only; the ranks stay the same."""
    from loamstone.operators import graph as N

    edges = [(f"s{i}", f"s{(i * 3 + 1) % 5}", 1.0 + i) for i in range(5)] + [(f"s{i}", f"leaf{i}-{k}", 0.5) for i in range(5) for k in range(40)]
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    written, kept = {}, N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: written.setdefault(name, kept(df, name)) if name == "inner-share" else kept(df, name))
    total = {s: sum(w for a, _, w in edges if a == s) for s, _, _ in edges}
    start = {"s0": 0.75, "leaf1-3": 0.25}
    want = dict(start)
    for _ in range(30):
        after = {k: 0.15 * v for k, v in start.items()}
        for a, b, w in edges:
            after[b] = after.get(b, 0.0) + 0.85 * want.get(a, 0.0) * w / total[a]
        want = after
    want = {k: v for k, v in want.items() if v > 1e-6}
    seeds = spark.createDataFrame([("s0", 3.0), ("leaf1-3", 1.0)], "id string, weight double")
    got = {r.id: r.r for r in N.ranked(table, seeds).collect()}
    many = {r.id: r.r for r in N.ranked_many(table, seeds.selectExpr("'q' AS query", "id", "weight")).collect()}
    for found in (got, many):
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert written["inner-share"].count() == 5


def test_many_queries_go_in_passes_of_bounded_tiles(spark, tmp_path, monkeypatch):
    import numpy as np

    from loamstone.operators import vector_index as V

    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((700, 6)), 1)  # many equal similarities
    vectors = spark.createDataFrame([(f"m{i}", u.tolist()) for i, u in enumerate(x)], "memory_id string, vec array<double>").repartition(3)
    queries = vectors.filter("memory_id LIKE '%7'").selectExpr("memory_id AS query", "vec")
    whole = as_set(V.nearest_many(vectors, queries, 5))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"m{i}" for i in range(700)]
    for i in (7, 77, 697):
        sims = np.round(x @ unit[i], 9)
        assert [n for _, n in sorted((rank, name) for q, name, _, rank in whole if q == f"m{i}")] == [n for _, n in sorted(zip((-sims).tolist(), names))[:5]]
    monkeypatch.setattr(V, "QUERY_NUMBERS", 20 * 6)  # 70 queries in four passes; before, too many were refused
    monkeypatch.setattr(V, "TILE", 8)
    monkeypatch.setattr(V, "CELLS", 64)
    assert as_set(V.nearest_many(vectors, queries, 5)) == whole
    V.write_lists(vectors, V.fitted_centroids(vectors, 6), str(tmp_path / "lists"))
    assert as_set(V.search_lists(spark, str(tmp_path / "lists"), queries, 5, 6)) == whole


def test_differences_make_only_pairs_with_a_side_that_moves(spark):
    import random

    from loamstone.operators import concept_deltas as D

    r = random.Random(8)
    rows = [(f"m{i}", f"c{r.randint(0, 6)}", r.random() < 0.6, r.random() < 0.6) for i in range(40) for _ in range(2)]
    rows = [v for v in {(m, c): (m, c, b0, b1) for m, c, b0, b1 in rows}.values() if v[2] or v[3]]
    told = spark.createDataFrame(rows, "memory_id string, concept_id string, b0 boolean, b1 boolean")
    for of, by, at in (("memory_id", "concept_id", 0), ("concept_id", "memory_id", 1)):
        want = {}
        for x in rows:
            for y in rows:
                if x[1 - at] == y[1 - at] and x[at] < y[at]:
                    want[x[at], y[at]] = want.get((x[at], y[at]), 0.0) + (x[3] and y[3]) - (x[2] and y[2])
        assert as_set(D._moved_pairs(told, of, by)) == {(a, b, float(w)) for (a, b), w in want.items() if w}
    batch = spark.createDataFrame(notes(30), SCHEMA)
    assert set(D.begun(batch, None, ())) == {"concept_reps", "concept_links", "concept_counts"}  # before, pairs were always made
