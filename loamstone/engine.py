"""A facade over the operators: tables in one folder, calls that read, append to or rewrite them.

A table is a Parquet folder of one base version and the parts appended since. Stores, touches, events and telemetry append
a part; what they change in other tables is folded in where a table is read (recall counts, densities, mention counts) and
for good when the table is compacted. Calls that change rows in place write the next base version; readers keep theirs, and
a lost executor costs a stage.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loamstone import schemas
from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import concept_deltas as D
from loamstone.operators import fulltext as T
from loamstone.operators import governance as G
from loamstone.operators import graph as N
from loamstone.operators import jobs as J
from loamstone.operators import memory as M
from loamstone.operators import recall as C
from loamstone.operators import register as Q
from loamstone.operators import retrieval as R
from loamstone.operators import vector_index as V
from loamstone.operators.sealed import stored_key

#: Base versions kept, and appended parts after which a table is compacted.
KEEP, PARTS = 3, 32
BATCH, RUNS_KEPT, ITEM_DAYS = 500, 5000, 30
#: What a depth's limit, made for one file on one machine, is multiplied by for jobs of a cluster.
PATIENCE = 100.0
#: Seconds between two refreshes of the graph.
REFRESH = 60
CONSTITUTION = "# 宪法\n\nWrite here, one to a line, the rules that hold for every agent; proposals to change them wait for people.\n"
Principal = tuple[str, str]


def _digest(*parts: str, size: int = 24) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:size]


class Engine:
    """Memories and all that belongs to them below ``path``. ``now`` gives epoch seconds; ``embed`` makes a query's vector; ``background`` keeps the graph up behind stores."""

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], int], owner: str = "owner", embed: Callable[[list[str], int], list] | None = None, dim: int = 1024, patience: float = PATIENCE, background: bool = False):
        self.spark, self.path, self.now, self.owner, self.embed, self.dim, self.patience, self.background = spark, path.rstrip("/"), now, owner, embed, dim, patience, background
        self._vectors: dict[str, list[float]] = {}
        self._refreshing, self._refreshed, self._refresher = threading.Lock(), -REFRESH, None
        self.warm: set[str] = set()
        self.warming: threading.Thread | None = None

    # tables

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self, name: str) -> list[tuple[int, int]]:
        """(version, part) of what is there whole; part 0 is the base."""
        fs, base = self._fs(f"{self.path}/{name}")
        if not fs.exists(base):
            return []
        whole = [s.getPath() for s in fs.listStatus(base) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(tuple(int(x) for x in p.getName().partition("=")[2].split(".")) for p in whole)

    def table(self, name: str) -> DataFrame:
        found = self._parts(name)
        if not found:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        last = max(v for v, _ in found)
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*[f"{self.path}/{name}/v={v}.{p}" for v, p in found if v == last])

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], schemas.TABLES[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def replace(self, name: str, df: DataFrame) -> None:
        """Write the next base version; old ones go after KEEP."""
        found = sorted({v for v, _ in self._parts(name)})
        self._shaped(name, df).write.parquet(f"{self.path}/{name}/v={(found or [0])[-1] + 1}.0")
        for v, p in self._parts(name):
            if v in found[: -KEEP or None]:
                fs, old = self._fs(f"{self.path}/{name}/v={v}.{p}")
                fs.delete(old, True)

    def append(self, name: str, new: DataFrame) -> None:
        """Write one more part; after PARTS of them the table is compacted."""
        found = self._parts(name)
        v, p = found[-1] if found else (1, -1)
        self._shaped(name, new).write.parquet(f"{self.path}/{name}/v={v}.{p + 1}")
        if p + 1 >= PARTS:
            self.compact(name)

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schemas.TABLES[name])

    def compact(self, name: str) -> None:
        if name in ("touches", "densities", "memories"):
            self.replace("memories", self.memories())
            for empty in ("touches", "densities"):
                self.replace(empty, self.spark.createDataFrame([], schemas.TABLES[empty]))
        elif name == "postings":
            self.replace(name, T.sorted_postings(self.table(name)))
        else:
            folded = {"concepts": self.concepts, "dangling_refs": self.dangling, "seen": self.seen}
            self.replace(name, folded[name]() if name in folded else self.table(name))

    def memories(self) -> DataFrame:
        """Memories with the touches and densities since the last compaction."""
        rows = M.touched(self.table("memories"), self.table("touches"))
        latest = self.table("densities").groupBy("id").agg(F.max_by("connection_density", "seq").alias("d"))
        return rows.join(latest, "id", "left").withColumn("connection_density", F.coalesce("d", "connection_density")).drop("d")

    def concepts(self) -> DataFrame:
        """Concepts with the mentions since the last reindex, which alone counts documents and finds hubs."""
        return self.table("concepts").groupBy("concept_id").agg(F.min("name").alias("name"), F.max("kind").alias("kind"), F.sum("mention_count").alias("mention_count"), F.max("doc_freq").alias("doc_freq"), F.bool_or("is_hub").alias("is_hub"))

    def dangling(self) -> DataFrame:
        """Names that links use, by mentions."""
        return self.table("dangling_refs").groupBy("name").agg(F.sum("mention_count").alias("mention_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.bool_or("promoted").alias("promoted"))

    def version(self, scope: str = "global") -> int:
        """The version of a shared scope: 1 until something is promoted or superseded in it."""
        return self.table("versions").filter(F.col("scope_id") == scope[:160]).agg(F.coalesce(F.max("version"), F.lit(1)).alias("v")).first().v

    def _next_version(self, scope: str, expected: int, content: str, step: int = 1) -> int:
        found = self.version(scope)
        self._check_version(found, expected)
        self.append("versions", self._rows("versions", [(scope[:160], found + step, content, self.now())]))
        return found + step

    @staticmethod
    def _check_version(found: int, expected: int) -> None:
        if expected and expected != found:
            raise RuntimeError(f"stale shared state: expected {expected}, current {found}")

    # writing

    def _row(self, r: dict, i: int, now: int) -> tuple:
        meta = r.get("meta") or {}
        meta = json.loads(meta) if isinstance(meta, str) else dict(meta)
        source = str(r.get("source_id") or meta.get("source_id") or "").strip()
        if source:
            meta.setdefault("source_id", source)
        mid = r.get("id") or "m-" + (_digest("source", source) if source else uuid.uuid4().hex[:24])
        return (mid, r["kind"], r["content"], r.get("mode_id", ""), r.get("persona_id") or meta.get("persona_id"), int(r.get("importance", 2)), now, now, 0, float(r.get("emotional_tag", 0)), 0.5, 0.0, 0.0, json.dumps(meta, ensure_ascii=False), None, None, None, None, None, source or None)

    def store_batch(self, rows: list[dict], principal: Principal | None = None, trusted: bool = False, embed_now: bool = False) -> list[str]:
        """Store up to BATCH memories; one with the source of a stored one is not stored again. Returns the ids of all."""
        if not 0 < len(rows) <= BATCH:
            raise ValueError(f"a batch has 1 to {BATCH} memories")
        now = self.now()
        full = [self._row(r, i, now) for i, r in enumerate(rows)]
        new = self._rows("memories", full).withColumn("token_count", S.token_count(F.col("content")))
        new = M.first_of_source(new, self.table("memories").filter("source_id IS NOT NULL")).persist()
        for name, part in Q.registered(new, principal or ("user", self.owner), now, trusted).items():
            self.append(name, part)
        self.append("review_state", M.enrolled(new, self.table("review_state"), now))
        self._index(new, now)
        self.append("memories", new)
        if embed_now and self.embed is not None:
            self.append("memories_vec", J.embedded(new, self.embed, self.dim))
        new.unpersist()
        if self.background:
            self.refresh_graph()
        return [r[0] for r in full]

    def store(self, row: dict, principal: Principal | None = None, trusted: bool = False) -> str:
        """Store one memory, with its vector."""
        return self.store_batch([row], principal, trusted, embed_now=True)[0]

    def _index(self, new: DataFrame, now: int) -> None:
        """Postings of all new memories; links, concepts and mentions of all but raw chunks of books."""
        self.append("postings", T.postings(new).sortWithinPartitions("bucket", "term", "id", "position"))
        self.append("lengths", new.select("id", T.length("content").alias("dl")))
        tags = F.transform(X.listed_json(F.get_json_object("meta", "$.tags")), lambda x: F.lower(x))
        chunk = (F.col("kind") == "knowledge_book") & (F.get_json_object("meta", "$.scope") == "book_library") & F.array_contains(tags, "full_text")
        whole = new.filter(~F.coalesce(chunk, F.lit(False)))
        links = N.concept_links(whole.select("id", "content"))
        one, t = F.lit(1).cast("long"), F.lit(now).cast("long")
        self.append("concepts", links.groupBy("concept_id").agg(F.min("name").alias("name"), F.max("kind").alias("kind"), F.count("*").alias("mention_count")).withColumns({"doc_freq": F.lit(0).cast("long"), "is_hub": F.lit(False)}))
        self.append("mem_concepts", links.groupBy("memory_id", "concept_id").agg(F.max("weight").alias("weight")))
        names = whole.select(F.explode(F.array_distinct(X.wikilinks(F.coalesce("content", F.lit(""))))).alias("name"))
        self.append("dangling_refs", names.select("name", one.alias("mention_count"), t.alias("first_ts"), t.alias("last_ts"), F.lit(False).alias("promoted")))

    def sync_files(self, files: DataFrame) -> dict:
        """Bring the memories of files (name, kind, content, hash) up to date: new ones are stored, changed ones replaced."""
        mine = self.table("memories").filter(F.get_json_object("meta", "$.source") == "file_memory").select("id", F.get_json_object("meta", "$.name").alias("name"), F.get_json_object("meta", "$.content_hash").alias("hash"))
        plan = M.change_plan(files, mine).filter("action IN ('insert', 'replace')").join(files, "name").collect()
        gone = [r.id for r in mine.join(self.spark.createDataFrame([(r.name,) for r in plan if r.action == "replace"], "name string"), "name", "left_semi").collect()]
        if gone:
            self.delete(gone)
        for lo in range(0, len(plan), BATCH):
            self.store_batch([{"kind": r.kind, "content": r.content, "importance": 5, "mode_id": r.name, "meta": {"source": "file_memory", "name": r.name, "title": r.name, "content_hash": r.hash}} for r in plan[lo : lo + BATCH]])
        return {"added": sum(r.action == "insert" for r in plan), "updated": sum(r.action == "replace" for r in plan)}

    def add_edge(self, src: str, dst: str, weight: float = 1.0, kind: str = "cooccur") -> None:
        """Set an edge, and count the ends of both its memories anew."""
        if src == dst:
            raise ValueError("a memory has no edge to itself")
        self.replace("edges", J.upserted(self.table("edges"), self._rows("edges", [(src, dst, weight, kind)]), "src", "dst"))
        near = self.table("edges").filter(F.col("src").isin(src, dst) | F.col("dst").isin(src, dst))
        seq = len(self._parts("densities")) + 1
        self.append("densities", N.density(near).filter(F.col("id").isin(src, dst)).withColumn("seq", F.lit(seq).cast("long")))

    def reindex(self) -> dict:
        """Rebuild postings, concepts, links and co-occurrence edges from the live memories; edges of other kinds stay."""
        rows = M.live(self.memories())
        self.replace("postings", T.sorted_postings(T.postings(rows)))
        self.replace("lengths", rows.select("id", T.length("content").alias("dl")))
        for name, df in D.begun(rows).items():
            self.replace(name, df)
        self.replace("concept_seen", rows.select("id", F.lit("seen").alias("state")))
        self._publish()
        return {"memories": self.table("lengths").count(), "concepts": self.table("concepts").count(), "cooccur_edges": self.table("edges").filter("kind = 'cooccur'").count(), "concept_edges": self.table("concept_edges").count()}

    def _publish(self) -> None:
        """Concepts, their members, both kinds of edges and densities as the logs of the concept graph tell them."""
        logs = {n: self.table(n) for n in D.LOGS}
        self.replace("concepts", D.concepts(logs))
        self.replace("mem_concepts", D.links(logs).groupBy("memory_id", "concept_id").agg(F.max("weight").alias("weight")))
        pairs = D.concept_pairs(logs)
        self.replace("concept_edges", pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(pairs.select("b", "a", "weight")))
        made = N.cooccurrence_edges(D.memory_pairs(logs)).withColumn("kind", F.lit("cooccur"))
        other = self.table("edges").filter("kind <> 'cooccur'")
        self.replace("edges", other.unionByName(made.join(other, ["src", "dst"], "left_anti").select("src", "dst", "weight", "kind")))
        self.rebuild_densities()

    def advance_graph(self) -> int:
        """Bring the concept graph up to date with what was stored since: by differences, or anew if memories went. Returns the number of new ones."""
        seen = self.table("concept_seen")
        states = {r.state: r["count"] for r in seen.groupBy("state").count().collect()}
        new = M.live(self.table("memories")).join(seen.filter("state = 'seen'"), "id", "left_anti")
        n = new.count()
        if states.get("dirty") or states.get("begun", 0) != states.get("done", 0):  # the last one was cut off
            self.reindex()
            return n
        if n:
            mark = lambda state: self.append("concept_seen", self._rows("concept_seen", [(None, state)]))
            made = D.advance({t: self.table(t) for t in D.LOGS}, new)
            mark("begun")
            for name, df in made.items():
                self.append(name, df)
            self.append("concept_seen", new.select("id", F.lit("seen").alias("state")))
            self._publish()
            mark("done")
        return n

    def refresh_graph(self, wait: bool = False) -> bool:
        """Let one job bring the graph up to date, at most every REFRESH seconds; readers keep the version they have meanwhile. False if none began."""
        with self._refreshing:
            if self._refresher is not None and self._refresher.is_alive() or self.now() - self._refreshed < REFRESH:
                return False
            self._refreshed = self.now()
            self._refresher = threading.Thread(target=self.advance_graph, name="graph", daemon=True)
            self._refresher.start()
        if wait:
            self._refresher.join()
        return True

    def rebuild_densities(self) -> None:
        rows = M.touched(self.table("memories"), self.table("touches"))
        dens = N.density(self.table("edges")).withColumnRenamed("connection_density", "d")
        self.replace("memories", rows.join(dens, "id", "left").withColumn("connection_density", F.coalesce("d", F.lit(0.0))))
        for empty in ("touches", "densities"):
            self.replace(empty, self.spark.createDataFrame([], schemas.TABLES[empty]))

    def rebuild_postings(self) -> int:
        """Postings of all memories, invalid ones too."""
        self.replace("postings", T.sorted_postings(T.postings(self.table("memories"))))
        self.replace("lengths", self.table("memories").select("id", T.length("content").alias("dl")))
        return self.table("lengths").count()

    def consolidate(self, threshold: int = 3, full_reindex: bool = True) -> dict:
        """Reindex if asked, and promote the names with ``threshold`` mentions that have become concepts."""
        done = self.reindex() if full_reindex else {}
        ready = J.promoted_dangling(self.dangling().filter((F.col("mention_count") >= threshold) & ~F.col("promoted")), self.concepts())
        names = ready.select("name").withColumns({"mention_count": F.lit(0), "first_ts": F.lit(None), "last_ts": F.lit(None), "promoted": F.lit(True)})
        n = ready.count()
        if n:
            self.append("dangling_refs", names)
        return done | {"dangling_promoted": n}

    def backfill_vectors(self, embed: Callable | None = None, dim: int | None = None, limit: int = 0) -> int:
        """Vectors for the live memories without one; a run that was cut off is gone on with. Returns how many were added."""
        rows = R.missing(self.table("memories"), self.table("memories_vec"))
        rows = rows.orderBy("created_ts", "id").limit(min(limit, 1000)) if limit else rows
        before = self.table("memories_vec").count()
        made = J.backfill(rows, f"{self.path}/backfill", embed or self.embed or J.hash_embedding, dim or self.dim)
        self.append("memories_vec", made.join(self.table("memories_vec").select("memory_id"), "memory_id", "left_anti").join(self.table("memories").select(F.col("id").alias("memory_id")), "memory_id", "left_semi"))
        return self.table("memories_vec").count() - before

    def query_vector(self, query: str) -> list[float] | None:
        """The query's vector; up to 256 of them are remembered."""
        if self.embed is None:
            return None
        if query not in self._vectors:
            if len(self._vectors) >= 256:
                self._vectors.clear()
            try:
                self._vectors[query] = [float(x) for x in self.embed([query[:8000]], self.dim)[0]]
            except OSError:
                return None
        return self._vectors[query]

    # vectors

    def build_vector_index(self, lists: int | None = None) -> int:
        """Part all vectors into lists by centroids of a sample; searches then read some of the lists. Returns their number."""
        vectors = self.table("memories_vec")
        lists = lists or max(2, round(vectors.count() ** 0.5))
        V.write_lists(vectors, V.fitted_centroids(vectors, lists), f"{self.path}/vector_lists")
        return lists

    def search_vectors(self, query: str, k: int = 20, timeout_ms: float = 0, warm_only: bool = False) -> list[Row] | None:
        """query, memory_id, sim and rank of the k nearest memories; None if that takes longer than ``timeout_ms``.

        With ``warm_only`` vectors that weren't read yet are not waited for: they are read behind, and nothing is found. From
        INDEX_THRESHOLD vectors on, or where an index was built, the index's lists are searched.
        """
        if warm_only and "memories_vec" not in self.warm:
            if self.warming is None or not self.warming.is_alive():
                self.warming = threading.Thread(target=lambda: (self.table("memories_vec").count(), self.warm.add("memories_vec")), daemon=True)
                self.warming.start()
            return []

        def work() -> list[Row]:
            vector = self.query_vector(query)
            if vector is None:
                return []
            one = self.spark.createDataFrame([(query, [float(x) for x in vector])], "query string, vec array<double>")
            fs, lists = self._fs(f"{self.path}/vector_lists/centroids")
            indexed = fs.exists(lists)
            if not indexed and self.table("memories_vec").count() >= R.INDEX_THRESHOLD:
                self.build_vector_index()
                indexed = True
            found = V.search_lists(self.spark, f"{self.path}/vector_lists", one, k) if indexed else V.nearest_many(self.table("memories_vec"), one, k)
            return found.orderBy("rank").collect()

        return C.Channels(self.spark, timeout_ms / 1000 if timeout_ms else None).run({"vector": work})["vector"]

    # reading

    def index(self, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Postings and statistics, of all memories that are indexed or of some."""
        lengths = self.table("lengths") if rows is None else self.table("lengths").join(rows.select("id"), "id", "left_semi")
        return self.table("postings"), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def allowed(self, principal: Principal | None = None, roles: list[str] | None = None) -> DataFrame:
        return G.allowed(self.table("memories"), self.table("memory_cognitive"), self.table("memory_acl"), principal or ("user", self.owner), roles or [], self.now(), self.owner)

    def readable(self, principal: Principal | None = None, roles: list[str] | None = None) -> DataFrame:
        """Live memories that the principal (by default the owner) may read."""
        return self.memories().join(self.allowed(principal, roles), "id", "left_semi")

    def touch(self, ids: list[str]) -> None:
        if ids:
            self.append("touches", self._rows("touches", [(i, self.now()) for i in ids]))

    def get(self, memory_id: str, principal: Principal | None = None, roles: list[str] | None = None) -> Row | None:
        """The memory with its tier, counted as recalled; None if it isn't there or isn't readable."""
        row = self.readable(principal, roles).filter(F.col("id") == memory_id).withColumn("tier", S.tier_of(S.retrievability(self.now()))).first()
        if row is not None:
            self.touch([memory_id])
        return row

    def bundle(self, bundle_id: str, principal: Principal | None = None, roles: list[str] | None = None) -> dict | None:
        """The text of a bundle's readable parts in order, each counted as recalled."""
        if not M.is_bundle_id(bundle_id):
            raise ValueError("not the id of a bundle")
        rows = self.readable(principal, roles).filter(F.get_json_object("meta", "$.bundle_id") == bundle_id).withColumns({"bundle_id": F.lit(bundle_id), "chunk_index": F.coalesce(F.expr("try_cast(get_json_object(meta, '$.chunk_index') AS int)"), F.lit(0))})
        whole = M.bundle(rows).first()
        if whole is None:
            return None
        ids = [r.id for r in rows.select("id", "chunk_index").orderBy("chunk_index", "id").limit(1000).collect()]
        self.touch(ids)
        return {"content": whole.content, "items": ids, "characters": len(whole.content)}

    def recall(self, query: str | None = None, k: int = 10, seeds: list[str] | None = None, static: bool = False, touch: bool = True, full_text: bool = False, **where) -> list[Row]:
        """The k most active memories that fit; with seeds, or the first full-text hits as seeds, what is near them in the graph gains."""
        rows = self.readable()
        if full_text and query:
            found = T.entries(M.live(self.memories()), query, X.query_terms(query), max(50, 5 * k), self.index()).collect()
            rows = rows.join(self.spark.createDataFrame([(r.id,) for r in found], "id string"), "id", "left_semi")
            seeds, query = seeds or [r.id for r in sorted(found, key=lambda r: r.position)[:5]], None
        bonus = N.spread(self.table("edges"), self.spark.createDataFrame([(s,) for s in seeds], "id string")) if seeds and not static else None
        rows = M.recall(rows, self.now(), k, static=static, bonus=bonus, query=query, **where).collect()
        if touch:
            self.touch([r.id for r in rows])
        return rows

    def recall_hybrid(self, query: str, k: int = 8, touch: bool = True, **options) -> list[Row]:
        """Hybrid recall: similarity, spreading rank and activation."""
        rows = C.hybrid(self.memories(), self.table("memories_vec"), self.table("edges"), self.now(), query, self.query_vector(query), k, index=self.index(), **options).collect()
        if touch:
            self.touch([r.id for r in rows])
        return rows

    def dream_effect(self, on: str | None = None) -> DataFrame:
        on = on or time.strftime("%Y-%m-%d", time.gmtime(self.now()))
        return G.dream_effect(self.table("dream_events"), on)

    def recall_planned(self, query: str, vector: list[float] | None = None, depth: str = "Q2", principal: Principal | None = None, roles: list[str] | None = None, limit: int = 8, token_budget: int = 1600, max_chars: int = 0, timeout_ms: int = 0, touch: bool = True, dreams: bool = True, session_id: str = "", project: str = "", **wanted) -> dict:
        """Fused lexical, vector and graph candidates after access, filters and budgets; the run and its audit are recorded.

        The shallow depths search hot memories only. The limit is the depth's (times ``patience``), or ``timeout_ms`` if that is
        less. Its first part is the channels': one that isn't done then is cancelled, and the others' candidates are fused
        (``partial``, stop_reason ``timeout``, ``late`` names the channels). A plan that isn't done at the end gives nothing
        but ``partial``.
        """
        depth = S.depth(depth)
        most, items, chars, *_ = S.DEPTHS[depth]
        most = most * self.patience
        limit_ms = min(timeout_ms or most, most)
        if not items:
            return {"items": [], "candidates": 0, "tokens": 0, "partial": False, "stop_reason": "conversation_only"}
        began, memories = time.time(), self.memories()
        rows = M.live(memories) if depth == "Q3" else M.hot(memories, self.table("memory_cognitive"))
        channels = C.Channels(self.spark, limit_ms / 1000)
        dream = self.dream_effect() if dreams else self.spark.createDataFrame([], "memory_id string, dream double")

        def plan() -> tuple[list[Row], list[Row]]:
            found, denied = C.rrf_candidates(memories, rows, self.table("memories_vec"), self.table("edges"), self.allowed(principal, roles), query, (lambda: self.query_vector(query)) if vector is None else vector, depth, self.index(rows), channels)
            chosen, audit = C.planned(found, denied, self.table("memory_cognitive"), self.table("memory_facets"), self.table("memory_conflicts"), self.table("memory_evidence"), dream, min(limit, items), min(max_chars or chars, chars), token_budget, depth, project=project, **wanted)
            return chosen.collect(), audit.collect()

        done = self.within(limit_ms, plan)
        if done is None:
            return {"items": [], "candidates": 0, "tokens": 0, "partial": True, "stop_reason": "timeout", "late": sorted(channels.late)}
        chosen, audit = done
        chosen = sorted(chosen, key=lambda r: r.final_rank)
        reasons = {r.filter_reason for r in audit}
        stop = next((s for s in ("char_budget", "token_budget", "budget", "item_budget") if f"{s}_dropped" in reasons), "item_budget" if len(chosen) >= min(limit, items) else "complete") if audit else "no_match"
        stop = "timeout" if channels.late else stop
        now, run_id = self.now(), "rr-" + uuid.uuid4().hex[:16]
        counts: dict[str, int] = {}
        for r in chosen:
            counts[r.kind or "memory"] = counts.get(r.kind or "memory", 0) + 1
        tokens, candidates = sum(r.tokens for r in chosen), sum(r.permission_result == "allowed" for r in audit)
        self.append("retrieval_runs", self._rows("retrieval_runs", [(run_id, session_id[:200], _digest(query), depth, candidates, len(chosen), tokens, round(1000 * (time.time() - began), 2), counts, now)]))
        if audit:
            self.append("run_items", self._rows("run_items", [(run_id, r.id, r.lexical_rank, r.vector_rank, r.graph_rank, float(r.rrf_score or 0), r.permission_result, r.filter_reason, r.final_rank, now) for r in audit]))
        if touch:
            self.touch([r.id for r in chosen])
        return {
            "run_id": run_id, "items": chosen, "audit": audit, "candidates": candidates, "tokens": tokens, "source_counts": counts, "partial": stop not in ("complete", "no_match"), "stop_reason": stop, "late": sorted(channels.late), "shared_state_version": self.version(project or "global"),
            "evidence_pack": [{"memory_id": r.id, "source_id": r.source_id or "", "evidence": [e.asDict() for e in r.evidence or []], "open_conflicts": list(r.open_conflicts or [])} for r in chosen],
            "citation_pack": [{"memory_id": r.id, "source_id": r.source_id or "", "root_source_id": r.root_source_id or "", "locators": list(r.locators)} for r in chosen],
        }

    def within(self, timeout_ms: float, work: Callable):
        """``work()``, or None if its Spark jobs aren't done in time; they are cancelled then."""
        if not timeout_ms:
            return work()
        sc, group, late = self.spark.sparkContext, f"recall-{time.monotonic_ns()}", threading.Event()
        sc.setJobGroup(group, "bounded recall", True)
        timer = threading.Timer(timeout_ms / 1000, lambda: (late.set(), sc._jsc.sc().cancelJobGroupAndFutureJobs(group)))
        timer.start()
        try:
            done = work()
            return None if late.is_set() else done
        except Exception:
            if late.is_set():
                return None
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def connect(self, a: list[str], b: list[str], hops: int = 4) -> Row | None:
        ids = lambda x: self.spark.createDataFrame([(i,) for i in x], "id string")
        return N.shortest(self.table("edges"), ids(a), ids(b), hops).first()

    def connect_queries(self, a: str, b: str, k: int = 8, hops: int = 3) -> Row | None:
        """The first shortest path between what two queries find, with the connector and the texts on it."""
        rows, index = M.live(self.memories()), self.index()
        ends = [T.entries(rows, q, X.query_terms(q), k, index).select("id") for q in (a, b)]
        path = N.shortest(self.table("edges"), *ends, hops)
        texts = path.select("hops", "path", "connector", F.posexplode("path").alias("at", "id")).join(self.table("memories").select("id", F.substring("content", 1, 80).alias("snippet")), "id", "left")
        return texts.groupBy("hops", "path", "connector").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "snippet"))), lambda x: x.snippet).alias("snippets")).first()

    def connect_ranked(self, a: str, b: str, k: int = 12, personal: bool = True) -> dict:
        """What connects two queries: typed relations between what they find, memories that rank for both, else a semantic bridge."""
        rows, vecs, index = self.memories(), self.table("memories_vec"), self.index()
        va, vb, both = self.query_vector(a), self.query_vector(b), self.query_vector(f"{a} {b}")
        x, y = (C.rich_seeds(rows, vecs, q, v, k, personal, index) for q, v in ((a, va), (b, vb)))
        typed = self.table("typed_edges")
        said = [(r.rel_type, r.because) for r in C.typed_between(typed, x, y).orderBy("id").collect()]
        if both is not None:
            said += [(r.rel_type, r.because) for r in C.relations(typed, both, 3).collect() if r.because not in {s for _, s in said}]
        found = [(r.id, r.score) for r in C.connectors(self.table("edges"), x, y).collect()]
        method = "ppr" if found else "semantic_bridge"
        if not found and va is not None and vb is not None:
            found = [(r.memory_id, r.sim) for r in R.bridge(vecs, va, vb).collect()]
        return {"connected": bool(found), "method": method, "connectors": found, "typed_relations": said[:3]}

    def relations(self, query: str, k: int = 5) -> list[Row]:
        v = self.query_vector(query)
        return [] if v is None else C.relations(self.table("typed_edges"), v, k).collect()

    def list_concepts(self, limit: int = 30, hub: bool | None = None) -> list[Row]:
        df = self.concepts()
        return (df if hub is None else df.filter(F.col("is_hub") == hub)).orderBy(F.desc("mention_count"), "concept_id").limit(limit).collect()

    def list_dangling(self, least: int = 1, limit: int = 50) -> list[Row]:
        """Names that links use and how often, the most mentioned first."""
        return self.dangling().filter(F.col("mention_count") >= least).orderBy(F.desc("mention_count"), "name").limit(limit).collect()

    def digest(self, project: str = "", limit: int = 8, personal: bool = True) -> dict:
        """Counts, the memories that matter most (of a project, if it has any), and the themes of the concept graph."""
        rows = M.live(self.memories())
        counts = {n: self.table(t).count() for n, t in (("memories", "memories"), ("edges", "edges"), ("embedded", "memories_vec"))}
        counts |= {"concepts": self.concepts().count(), "due_review": self.table("review_state").filter(F.col("next_review_ts") <= self.now()).count()}
        top = self.recall_hybrid(project, limit, personal=personal) if project else []
        top = top or M.important(rows.filter(F.col("kind").isin(M.PERSONAL)) if personal else rows, limit).collect()
        return {"counts": counts, "top": top, "themes": N.themes(self.table("concept_edges"), self.concepts()).collect()}

    def stats(self) -> dict:
        """Counts by form, stage, tier, verification, inbox and activation, the largest domains, the latest runs, what is warm."""
        side, by = self.table("memory_cognitive"), lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
        total, vectors = self.table("memories").count(), self.table("memories_vec").count()
        top = self.table("memory_facets").filter("facet_type = 'domain'").groupBy("facet_value").count().orderBy(F.desc("count"), "facet_value").limit(20).collect()
        return {
            "total_memories": total, "classified_memories": side.count(), "forms": by(side, "memory_form"), "lifecycle": by(side, "lifecycle_stage"), "tiers": by(side, "memory_tier"), "verification": by(side, "verification_status"),
            "domains": [(r[0], r[1]) for r in top], "inbox": by(self.inbox(), "status"), "activations": by(self.table("memory_activations"), "activation_kind"), "open_conflicts": self.table("memory_conflicts").filter("status = 'open'").count(),
            "dream_events": self.table("dream_events").count(), "recent_runs": self.table("retrieval_runs").orderBy(F.desc("created_ts"), "run_id").limit(20).collect(), "hot_memories": M.hot(self.table("memories"), side).count(),
            "vectors": vectors, "index_wanted": vectors >= R.INDEX_THRESHOLD, "ready": sorted(self.warm),
        }

    def warm_up(self) -> dict:
        """Read the postings, vectors and edges once, so that the first recalls find them in the caches."""
        for name in ("postings", "memories_vec", "edges"):
            self.table(name).count()
            self.warm.add(name)
        T.search(M.live(self.memories()), ["project"], 8, self.index()).count()
        return self.ready()

    def ready(self) -> dict:
        parts = {n: "ready" if t in self.warm else "cold" for n, t in (("lexical", "postings"), ("vector", "memories_vec"), ("graph", "edges"))}
        return {"status": "ready" if set(parts.values()) == {"ready"} else "degraded", "components": parts}

    # reviews

    def due(self, limit: int = 20) -> list[Row]:
        return M.due(self.table("memories"), self.table("review_state"), self.now(), limit).collect()

    def enroll(self, memory_id: str, days: int = 1) -> int:
        """Put a memory under review; its first review is in ``days``."""
        if self.table("memories").filter(F.col("id") == memory_id).isEmpty():
            raise KeyError(memory_id)
        at = self.now() + days * S.DAY
        self.replace("review_state", J.upserted(self.table("review_state"), self._rows("review_state", [(memory_id, 2.5, days, 0, at, None)]), "memory_id"))
        return at

    def grade(self, memory_id: str, grade: int) -> Row:
        cards = self.table("review_state")
        hit = cards.filter(F.col("memory_id") == memory_id)
        if hit.isEmpty():
            raise KeyError(memory_id)
        new = M.graded(hit.withColumn("grade", F.lit(grade)), self.now()).withColumn("last_grade", F.lit(grade))
        self.replace("review_state", J.upserted(cards, self._shaped("review_state", new), "memory_id"))
        return self.table("review_state").filter(F.col("memory_id") == memory_id).first()

    def review_stats(self) -> Row:
        return M.review_stats(self.table("review_state"), self.now()).first()

    # life cycle

    def update_stability(self) -> None:
        new = M.with_stability(self.memories(), self.table("review_state"))
        self.replace("memories", M.touched(self.table("memories"), self.table("touches")).drop("stability", "difficulty").join(new, "id", "left"))
        self.replace("touches", self.spark.createDataFrame([], schemas.TOUCHES))

    def forget(self, threshold: float = 0.05, most: int = 50, dry_run: bool = True) -> list[Row]:
        """The plan of what to forget; unless dry, those memories and all that hangs on them are deleted."""
        plan = M.forget_plan(self.memories(), self.table("review_state"), self.now(), threshold, most).collect()
        if plan and not dry_run:
            self.delete([r.id for r in plan])
        return plan

    def forget_one(self, memory_id: str, force: bool = False, dry_run: bool = False) -> str:
        """not_found, protected (unless forced) or ok; deleted unless dry."""
        row = M.protected(self.memories().filter(F.col("id") == memory_id), self.table("review_state")).first()
        if row is None:
            return "not_found"
        if row.protected and not force:
            return "protected"
        if not dry_run:
            self.delete([memory_id])
        return "ok"

    def delete(self, ids: list[str]) -> None:
        """Delete memories with all that hangs on them; episodes of the inbox lose their memory but stay."""
        self._forget_graph()
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        keys = {"memories": ("id",), "edges": ("src", "dst"), "typed_edges": ("src", "dst"), "memory_conflicts": ("left_memory_id", "right_memory_id"), "memory_lineage": ("child", "parent"), **dict.fromkeys(("touches", "densities", "postings", "lengths"), ("id",))}
        for name in schemas.TABLES:
            if name in ("concepts", "concept_edges", "dangling_refs", "retrieval_runs", "versions", "concept_seen", *D.LOGS) or not self._parts(name):
                continue
            if name == "inbox":
                hit = gone.select(F.col("id").alias("memory_id"), F.lit(True).alias("gone")).distinct()
                self.replace(name, self.table(name).join(hit, "memory_id", "left").withColumn("memory_id", F.when(F.col("gone"), "").otherwise(F.col("memory_id"))))
                continue
            self.replace(name, M.without(self.table(name), gone, *keys.get(name, ("memory_id",))))

    def _forget_graph(self) -> None:
        """The next refresh makes the concept graph anew."""
        if self._parts("concept_seen"):
            self.append("concept_seen", self._rows("concept_seen", [(None, "dirty")]))

    def invalidate(self, ids: list[str]) -> None:
        self._forget_graph()
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        self.replace("memories", M.invalidated(self.table("memories"), gone, self.now()))
        self.replace("review_state", M.without(self.table("review_state"), gone, "memory_id"))
        kept = self.table("edges").filter("kind <> 'cooccur'").unionByName(M.without(self.table("edges").filter("kind = 'cooccur'"), gone, "src", "dst"))
        self.replace("edges", kept)

    def supersede_unchecked(self, old: str, new: str) -> None:
        """Refused: replacement needs evidence, see ``supersede``."""
        raise RuntimeError("direct supersession is disabled; a governed one needs evidence")

    # governance

    def promote(self, memory_id: str, to_tier: str = "M1", parents: list[str] = (), evidence: list[dict] = (), run_id: str = "", principal: Principal | None = None, scope: str = "global", expected_version: int = 0, rule: str = Q.VERSION, **fields: str) -> dict:
        """Promote a memory if no reason speaks against it. New evidence and provenance fields are kept in either case."""
        to_tier = to_tier.strip().upper()
        if to_tier not in ("M1", "M2", "M3"):
            raise ValueError("a memory is promoted to M1, M2 or M3")
        side = self.table("memory_cognitive")
        if side.filter(F.col("memory_id") == memory_id).isEmpty():
            raise KeyError(memory_id)
        version = self.version(scope)
        self._check_version(version, expected_version)
        row = self._rows("memories", [self._row({"id": memory_id, "kind": "", "content": "", "meta": {"evidence": list(evidence)}}, 0, self.now())])
        proofs = G.complete(Q.evidence_of(row))
        self.replace("memory_evidence", J.upserted(self.table("memory_evidence"), proofs, "memory_id", "evidence_type", "locator"))
        counts = G.complete(self.table("memory_evidence")).groupBy("memory_id").agg(F.count("*").cast("int").alias("n"))
        hit = F.col("memory_id") == memory_id
        side = side.withColumns({k: F.when(hit, F.lit(v.strip())).otherwise(F.col(k)) for k, v in fields.items() if k in G.TIER_FIELDS and v}) if fields else side
        side = side.join(counts, "memory_id", "left").withColumn("evidence_count", F.when(hit, F.coalesce("n", F.lit(0))).otherwise(F.col("evidence_count"))).drop("n")
        self.replace("memory_cognitive", side)
        side, kin = self.table("memory_cognitive"), self.spark.createDataFrame([(memory_id, p.strip()[:160]) for p in list(dict.fromkeys(parents))[:32] if p.strip()], "memory_id string, parent_id string")
        one = side.join(kin.select(F.col("parent_id").alias("memory_id")).union(self.spark.createDataFrame([(memory_id,)], "memory_id string")).distinct(), "memory_id", "left_semi")
        reasons = G.promotion_reasons(one, self.table("memory_evidence"), self.table("memory_activations"), self.table("memory_conflicts"), kin, to_tier).filter(hit).first().reasons
        current = one.filter(hit).first()
        if reasons:
            return {"promoted": False, "current_tier": current.memory_tier, "reasons": reasons, "shared_state_version": version}
        if to_tier < current.memory_tier:
            raise ValueError("a promotion can't move a memory backwards")
        now, who = self.now(), ":".join(principal or ("user", self.owner))
        new = {"memory_tier": F.lit(to_tier), "verification_status": F.lit("verified"), "review_status": F.lit("active"), "last_verified_ts": F.lit(now).cast("long"), "governance_version": F.lit(rule[:80]), "updated_ts": F.lit(now).cast("long")}
        self.replace("memory_cognitive", side.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}))
        if not kin.isEmpty():
            relation = "summarizes" if to_tier == "M2" else "derived_from"
            self.append("memory_lineage", kin.select(F.col("memory_id").alias("child"), F.col("parent_id").alias("parent"), F.lit(relation).alias("relation_type")).join(self.table("memory_lineage"), ["child", "parent", "relation_type"], "left_anti"))
        promotion = "prom-" + _digest(memory_id, to_tier, rule, run_id, size=20)
        self.append("promotions", self._rows("promotions", [(promotion, memory_id, current.memory_tier, to_tier, rule[:80], run_id[:160], who[:120], now)]))
        return {"promoted": True, "from_tier": current.memory_tier, "to_tier": to_tier, "promotion_id": promotion, "shared_state_version": self._next_version(scope, 0, promotion)}

    def promote_nightly(self, limit: int = 100, run_id: str = "", scope: str = "global") -> list[str]:
        """M2 memories that pass the gate become M3, the most adopted first."""
        side = self.table("memory_cognitive")
        gate = G.promotion(side, self.table("memory_evidence"), self.table("memory_activations"), self.table("memory_conflicts"))
        ids = [r.memory_id for r in G.nightly(gate, side, limit).collect()]
        if ids:
            now, hit = self.now(), F.col("memory_id").isin(ids)
            self.replace("memory_cognitive", side.withColumns({"memory_tier": F.when(hit, "M3").otherwise(F.col("memory_tier")), "updated_ts": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_ts"))}))
            self.append("promotions", self._rows("promotions", [("prom-" + _digest(i, "M3", Q.VERSION, run_id, size=20), i, "M2", "M3", Q.VERSION, run_id[:160], f"user:{self.owner}", now) for i in ids]))
            self._next_version(scope, 0, _digest(*ids), len(ids))
        return ids

    def activate(self, memory_id: str, kind: str = "adopted", locator: str = "", occurred: str = "", session_id: str = "", key: str = "", principal: Principal | None = None) -> dict:
        """Record that a memory was adopted or confirmed, once for each key; being shown doesn't count."""
        kind, occurred = kind.strip().lower(), occurred.strip() or time.strftime("%Y-%m-%d", time.gmtime(self.now()))
        if kind not in ("adopted", "confirmed") or not locator.strip():
            raise ValueError("an activation is adopted or confirmed, and has a locator")
        day = self.spark.range(1).select(X.iso_date(F.lit(occurred)).alias("d")).first().d
        if day is None:
            raise ValueError("a date begins YYYY-MM-DD")
        side, hit = self.table("memory_cognitive"), F.col("memory_id") == memory_id
        if side.filter(hit).isEmpty():
            raise KeyError(memory_id)
        who = principal or ("user", self.owner)
        event = "act-" + (_digest(key.strip()) if key.strip() else _digest(memory_id, kind, session_id.strip()[:200], day.isoformat(), locator.strip()[:1000], *who))
        known = not self.table("memory_activations").filter(F.col("event_id") == event).isEmpty()
        if not known:
            self.append("memory_activations", self._rows("memory_activations", [(event, memory_id, kind, session_id.strip()[:200], day, locator.strip()[:1000], *who, self.now())]))
        counts = G.activation_counts(self.table("memory_activations").filter(hit)).first()
        if not known:
            new = {"activation_count": counts.activations, "adopted_count": counts.adopted, "confirmed_count": counts.confirmed}
            self.replace("memory_cognitive", side.withColumns({k: F.when(hit, F.lit(int(v))).otherwise(F.col(k)) for k, v in new.items()}))
        return {"event_id": event, "deduplicated": known, "activation_count": counts.activations, "distinct_dates": counts.dates, "distinct_sessions": counts.sessions}

    def dream(self, note_id: str, date: str, mentions: list[tuple[str, int, int]], principal: Principal | None = None, roles: list[str] | None = None) -> dict:
        """Record the mentions (memory, phases, segments) of a dream, once a note and memory; only verified, stable, readable memories gain."""
        if len(mentions) > 16:
            raise ValueError("a dream has at most 16 mentions")
        day = self.spark.range(1).select(X.iso_date(F.lit(date)).alias("d")).first().d
        if day is None or len(date) != 10:
            raise ValueError("a dream's date is YYYY-MM-DD")
        said = self.spark.createDataFrame([(m, p, s, i) for i, (m, p, s) in enumerate(mentions)], "memory_id string, phase_count int, segment_count int, position int")
        rows = G.dream_reasons(said, self.allowed(principal, roles), self.table("memory_cognitive")).withColumn("base_delta", S.dream_delta(F.col("phase_count"))).orderBy("position").collect()
        known = {r.event_id for r in self.table("dream_events").filter(F.col("dream_note_id") == note_id).select("event_id").collect()}
        good = [(r, "dream-access-" + _digest(note_id, r.memory_id)) for r in rows if r.reason is None]
        new = {e: (e, r.memory_id, note_id, day, r.phase_count, r.segment_count, r.base_delta, f"dream:{note_id}", self.now()) for r, e in reversed(good) if e not in known}
        if new:
            self.append("dream_events", self._rows("dream_events", list(new.values())))
        return {"accepted": [{"memory_id": r.memory_id, "event_id": e, "base_delta": r.base_delta, "deduplicated": e in known} for r, e in good], "rejected": [{"memory_id": r.memory_id, "reason": r.reason} for r in rows if r.reason is not None]}

    def dream_seeds(self, seed: str, limit: int = 4, max_chars: int = 2800, principal: Principal | None = None, roles: list[str] | None = None) -> list[Row]:
        return G.dream_seeds(self.memories(), self.table("memory_cognitive"), self.allowed(principal, roles), seed, limit, max_chars).orderBy("position").collect()

    def review_conflict(self, conflict: str, resolution: str, winner: str = "", locator: str = "") -> str:
        """Close a conflict, or call for more evidence; both its sides are relabelled by the conflicts that are left. Returns its status."""
        new = G.reviewed(self.table("memory_conflicts"), conflict, resolution.strip().lower(), winner, locator)
        self.replace("memory_conflicts", new)
        row = self.table("memory_conflicts").filter(F.col("conflict_id") == conflict).first()
        sides = self.spark.createDataFrame([(row.left_memory_id,), (row.right_memory_id,)], "memory_id string")
        self.replace("memory_cognitive", G.relabelled(self.table("memory_cognitive"), self.table("memory_conflicts"), sides))
        return row.status

    def supersede(self, old: str, new: str, locator: str, scope: str = "global", expected_version: int = 0) -> int:
        """Let a verified memory take another's place, with lineage, an edge and the end of their conflicts. Returns the scope's version."""
        if not locator.strip():
            raise ValueError("a supersession needs evidence")
        self._check_version(self.version(scope), expected_version)
        m, c, x = G.superseded(M.touched(self.table("memories"), self.table("touches")), self.table("memory_cognitive"), self.table("memory_conflicts"), old, new, self.now())
        self.replace("memories", m)
        self.replace("touches", self.spark.createDataFrame([], schemas.TOUCHES))
        self.replace("memory_cognitive", c)
        self.replace("memory_conflicts", x)
        self.append("memory_lineage", self._rows("memory_lineage", [(new, old, "supersedes")]))
        self.replace("edges", J.upserted(self.table("edges"), self._rows("edges", [(new, old, 1.0, "supersede")]), "src", "dst"))
        return self._next_version(scope, 0, _digest(old, new, locator))

    def backfill_governance(self, limit: int = 500) -> dict:
        """Sidecars for up to ``limit`` of the oldest memories without one; complete if there were fewer."""
        new = G.backlog(self.table("memories"), self.table("memory_cognitive"), limit).withColumns({"status": F.lit("active"), "updated_ts": F.lit(self.now())}).persist()
        n = new.count()
        self.append("memory_cognitive", new)
        new.unpersist()
        return {"processed": n, "complete": n < limit}

    # inbox

    def inbox(self) -> DataFrame:
        return self.table("inbox").groupBy("episode_id").agg(F.max_by(F.struct(*[f.name for f in self.spark.createDataFrame([], schemas.INBOX).schema if f.name != "episode_id"]), F.struct("updated_ts", F.col("status") != "staged")).alias("x")).select("episode_id", "x.*")

    def stage(self, key: str, summary: str, source_id: str = "", form: str = "episodic", domains: list[str] = (), entities: list[str] = (), evidence: list[dict] = (), importance: int = 2, confidence: float = 0.7, sensitivity: str = "internal", observed_at: str = "") -> str:
        """Put an episode into the inbox once a key; credentials are refused."""
        if form.lower() not in S.FORMS:
            raise ValueError("unknown memory form")
        proof = json.dumps(list(evidence), ensure_ascii=False)
        if self.spark.range(1).select(X.has_secret(F.lit(f"{summary}\n{proof}")).alias("x")).first().x:
            raise ValueError("the episode may hold a credential")
        episode = "hip-" + _digest(key, size=16)
        if self.table("inbox").filter(F.col("idempotency_key") == key).isEmpty():
            lists = [list(dict.fromkeys(str(x).strip()[:120] for x in xs if str(x).strip()))[:40] for xs in (domains, entities)]
            now = self.now()
            self.append("inbox", self._rows("inbox", [(episode, key, source_id[:300], summary, proof, form.lower(), *lists, importance, float(confidence), sensitivity[:40], observed_at[:80], "staged", "", now, now)]))
        return episode

    def settle(self, episode_id: str = "", source_id: str = "", memory_id: str = "", status: str = "promoted") -> int:
        """Set the status of an episode, or of all of a source; returns how many there were."""
        if not episode_id and not source_id:
            raise ValueError("an episode or a source is needed")
        status = status if status in ("promoted", "dismissed", "archived", "processed") else "promoted"
        hit = self.inbox().filter(F.col("episode_id") == episode_id if episode_id else F.col("source_id") == source_id)
        n = hit.count()
        if not n:
            raise KeyError(episode_id or source_id)
        self.append("inbox", hit.withColumns({"status": F.lit(status), "memory_id": F.lit(memory_id[:100]), "updated_ts": F.lit(self.now())}))
        return n

    def inbox_status(self, status: str = "", limit: int = 30) -> dict:
        """The latest episodes, of a status if one is given, and the number of each status."""
        rows = self.inbox()
        counts = {r[0]: r[1] for r in rows.groupBy("status").count().collect()}
        return {"counts": counts, "items": (rows.filter(F.col("status") == status) if status else rows).orderBy(F.desc("updated_ts"), "episode_id").limit(limit).collect()}

    # telemetry

    def fold_seen(self) -> None:
        """Count what recalls have shown, and keep the latest runs and thirty days of their items.

        Each run is a batch of counts of its own that is added once, however often it is folded, and stays when its items go.
        """
        shown = self.table("run_items").filter("final_rank IS NOT NULL").groupBy("memory_id", F.col("run_id").alias("batch")).agg(F.lit(1).cast("long").alias("n"), F.max("created_ts").alias("ts"))
        self.append("seen", shown.join(self.table("seen").select("batch").distinct(), "batch", "left_anti"))
        self.replace("retrieval_runs", self.table("retrieval_runs").orderBy(F.desc("created_ts"), F.desc("run_id")).limit(RUNS_KEPT))
        self.replace("run_items", self.table("run_items").filter(F.col("created_ts") >= self.now() - ITEM_DAYS * S.DAY))

    def seen(self) -> DataFrame:
        """The counts of runs; those of runs whose items are gone as one batch."""
        old = F.col("ts") < self.now() - (ITEM_DAYS + 1) * S.DAY
        return self.table("seen").groupBy("memory_id", F.when(old, F.lit("")).otherwise(F.col("batch")).alias("batch")).agg(F.sum("n").alias("n"), F.max("ts").alias("ts"))

    def sidecars(self) -> DataFrame:
        """The governance rows with all that was ever seen."""
        shown = self.table("seen").groupBy("memory_id").agg(F.sum("n").alias("n"))
        side = self.table("memory_cognitive").join(shown, "memory_id", "left")
        return side.withColumn("seen_count", (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int")).drop("n")

    # replicas, jobs

    def backup_key(self) -> bytes:
        """The key of the copies, made when first asked for; it has to be kept elsewhere too."""
        return stored_key(self.spark, f"{self.path}/backup.key")

    def back_up(self, memory_id: str, key: str | bytes, pools: J.Pools) -> int:
        """Place encrypted copies of a memory with the pools, in place of older ones. Returns how many wait for upload."""
        row = self.table("memories").filter(F.col("id") == memory_id)
        if row.isEmpty():
            raise KeyError(memory_id)
        made = pools.placed(J.replicas(row, key, self.now()))
        self.replace("shards", self.table("shards").filter(F.col("memory_id") != memory_id).unionByName(self._shaped("shards", made)))
        return self.table("shards").filter((F.col("memory_id") == memory_id) & F.col("pending_upload")).count()

    def restore(self, memory_id: str, key: str | bytes) -> Row | None:
        return J.restored(self.table("shards").filter(F.col("memory_id") == memory_id), key).first()

    def distill(self, note: Callable[[list[str]], dict | None]) -> int:
        """Make notes of clusters of new experiences: a semantic memory each, linked with its sources, which are marked."""
        rows = M.live(self.memories()).filter(F.col("kind").isin("episodic", "procedural") & ~F.coalesce(F.col("meta").contains('"consolidated": true'), F.lit(False)))
        vec = rows.join(self.table("memories_vec"), F.col("id") == F.col("memory_id")).select("id", "created_ts", "vec")
        notes = J.distilled(J.clusters(vec), rows, note)
        for made in notes:
            text = f"{made['title']}\n{made['insight']}" if made["title"] else made["insight"]
            mid = self.store_batch([{"kind": "semantic", "content": text, "importance": 4, "meta": {"distilled_from": made["sources"], "auto": True, "title": made["title"]}}])[0]
            links = [(mid, s, 3.0, "provenance") for s in made["sources"]] + [(s, mid, 3.0, "provenance") for s in made["sources"]]
            self.replace("edges", J.upserted(self.table("edges"), self._rows("edges", links), "src", "dst"))
            self.replace("memories", J.consolidated(self.table("memories"), made["sources"], mid))
        return len(notes)

    def relate(self, label: Callable[[str, str], dict | None]) -> int:
        """Label likely pairs of experiences with a typed relation, its reason and the reason's vector."""
        rows = M.live(self.memories()).filter(F.col("kind").isin(M.PERSONAL))
        vec = rows.join(self.table("memories_vec"), F.col("id") == F.col("memory_id")).select("id", "created_ts", "vec")
        provenance = self.table("edges").filter("kind = 'provenance'").select("src", "dst")
        pairs = J.relation_candidates(vec, self.table("edges").filter("kind <> 'provenance'"), self.table("typed_edges").select("src", "dst").union(provenance))
        texts = rows.select("id", "content")
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").orderBy(F.desc("sim"), "a", "b").collect()  # 20 at most
        found = J.labelled([(r.a, r.b, r.text_a, r.text_b) for r in both], label, self.query_vector, self.now())
        if found:
            self.append("typed_edges", self._rows("typed_edges", found))
        return len(found)

    def maps(self) -> int:
        """Write or renew a map of each well connected concept as a memory of its own."""
        made = N.concept_maps(self.table("concept_edges"), self.table("mem_concepts"), self.table("memories"), self.concepts()).collect()  # 50 at most
        old = {r.name: r.id for r in self.table("memories").filter("kind = 'moc'").select("id", F.get_json_object("meta", "$.moc_concept").alias("name")).collect()}
        if gone := [old[r.name] for r in made if r.name in old]:
            self.delete(gone)
        if made:
            self.store_batch([{"id": old.get(r.name), "kind": "moc", "content": r.content, "importance": 3, "meta": {"moc_concept": r.name, "degree": r.degree, "auto": True}} for r in made])
        return len(made)

    def render_vault(self, path: str) -> dict:
        """Markdown files of the best connected concepts and of all maps, and an index."""
        notes = N.concept_notes(self.table("concept_edges"), self.table("mem_concepts"), self.table("memories"), self.concepts())
        first = F.regexp_replace(F.get(F.split("content", "\n"), F.lit(0)), "^# 概念地图: ", "")
        mocs = self.table("memories").filter("kind = 'moc'").select(J.file_name(first, F.col("id"), 60).alias("name"), "content")
        return J.write_vault(notes, mocs, path)

    def constitution(self, path: str | None = None) -> str:
        """The constitution's text; a default one is written where there is none. Proposals only wait for people, see ``propose``."""
        fs, p = self._fs(path or f"{self.path}/constitution.md")
        if not fs.exists(p):
            out = fs.create(p)
            out.write(bytearray(CONSTITUTION.encode()))
            out.close()
        return self.spark.read.text(path or f"{self.path}/constitution.md", wholetext=True).first()[0]

    def propose(self, content: str) -> dict:
        return {"status": "queued_for_human_review", "preview_length": len(content)}

    def nightly(self, files: DataFrame | None = None, note: Callable | None = None, label: Callable | None = None, vault: str = "", full_reindex: bool = False, forget: bool = False, backup: Callable | None = None, backfill: int = 64) -> dict:
        """The nightly steps in order with a receipt; what isn't given is skipped, a failure stops the rest."""
        skip = lambda why: lambda: f"skipped: {why}"
        steps = [
            ("file_sync", (lambda: str(self.sync_files(files))) if files is not None else skip("no files")), ("distill", (lambda: self.distill(note)) if note else skip("no model")),
            ("consolidate", lambda: str(self.consolidate(full_reindex=full_reindex))), ("typed_edges", (lambda: self.relate(label)) if label else skip("no model")), ("backfill", lambda: self.backfill_vectors(limit=max(0, min(backfill, 1000))) if backfill else 0),
            ("stability", self.update_stability), ("maps", self.maps), ("vault", (lambda: str(self.render_vault(vault))) if vault else skip("no path")), ("promote", lambda: len(self.promote_nightly())), ("seen", self.fold_seen),
            ("forget", lambda: len(self.forget(most=100, dry_run=not forget))), ("backup", backup or skip("daily run")),
        ]
        return J.run_steps(steps, {"consolidate": [5, 15, 30]})
