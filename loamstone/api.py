"""The service's calls without a server: method, path and parameters in, a status and a JSON-like body out.

Who calls is decided here alone, from a token's digest and the maps that the service owns, never from parameters. Bad input
is 400, a missing thing 404, a stale or closed state 409; a failing backup is 500.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

from pyspark.sql import Row
from pyspark.sql import functions as F

from loamstone.engine import Engine
from loamstone.operators import jobs as J
from loamstone.operators import memory as M
from loamstone.sources.markdown import markdown

NAME, VERSION = "loamstone", "0.1.0"


class Refused(Exception):
    """A call that ends with a status of its own."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def plain(value):
    """Rows, tuples and dates as dicts, lists and strings."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, date) else bytes(value).hex() if isinstance(value, bytes | bytearray) else value


def token_key(token: str) -> str:
    return "sha256:" + hashlib.sha256(token.encode()).hexdigest()


def principal_of(token: str, agent: str, default: dict, tokens: dict[str, dict], agents: dict[str, dict]) -> dict:
    """The principal of a token: the default one, the token's own, or an agent that the token may stand for."""
    who = {"type": "user", "roles": [], **default, "source": "default_token"}
    key = token_key(token)
    if key in tokens:
        who = {"type": "user", "roles": [], **tokens[key], "source": "token_map"}
    if not who.get("id"):
        raise Refused(500, "the principal map is incomplete")
    if agent:
        own = agents.get(agent) or {}
        if key not in own.get("token_hashes", []):
            raise Refused(403, "the agent isn't mapped for this token")
        who = {"type": "agent", "id": own.get("principal_id") or agent, "roles": own.get("roles", []), "source": "agent_map"}
    return who | {"type": who["type"].strip()[:40], "id": who["id"].strip()[:160], "roles": [r.strip()[:160] for r in who["roles"] if r.strip()][:20]}


class Api:
    """``call`` runs one of ROUTES against an engine."""

    def __init__(self, engine: Engine, token: str, default: dict | None = None, tokens: dict | None = None, agents: dict | None = None, pools: J.Pools | None = None, key: str = "", config: dict | None = None, files: str = "", vault: str = ""):
        self.engine, self.token, self.default, self.tokens, self.agents = engine, token, default or {"id": engine.owner}, tokens or {}, agents or {}
        self.pools, self.key, self.config, self.files, self.vault = pools or J.Pools(), key, config or {}, files, vault

    def call(self, method: str, path: str, params: dict | None = None, token: str = "", agent: str = "") -> tuple[int, dict]:
        name, params = path.strip("/"), dict(params or {})
        try:
            if (method, name) in OPEN:
                return 200, plain(OPEN[method, name](self))
            if token != self.token:
                raise Refused(401, "invalid bearer token")
            who = principal_of(token, agent, self.default, self.tokens, self.agents)
            route = ROUTES.get((method, name))
            if route is None:  # the last part may be an id
                head, _, params["id"] = name.rpartition("/")
                route = ROUTES.get((method, f"{head}/*"))
            if route is None:
                raise Refused(404, "no such call")
            done = route(self, params, {"principal": (who["type"], who["id"]), "roles": who["roles"]})
            if done is None:
                raise Refused(404, "not found")
            return 200, plain(done)
        except Refused as e:
            return e.status, {"detail": str(e)}
        except KeyError as e:
            return 404, {"detail": str(e)}
        except (ValueError, TypeError) as e:
            return 400, {"detail": str(e)}
        except RuntimeError as e:
            return 409, {"detail": str(e)}

    def sync(self) -> dict:
        return self.engine.sync_files(markdown(self.engine.spark, self.files)) if self.files else {"skipped": "no folder", "synced": 0}

    def back_up(self, memory_id: str) -> dict:
        try:
            return {"memory_id": memory_id, "pending": self.engine.back_up(memory_id, self.key, self.pools)}
        except KeyError:
            raise
        except Exception as e:
            raise Refused(500, f"backup failed: {e!r}"[:300]) from e

    def retry(self) -> dict:
        shards = self.engine.table("shards")
        self.engine.replace("shards", self.pools.retried(shards))
        return {"pending": self.engine.table("shards").filter("pending_upload").count()}

    def set_config(self, submitted: dict) -> dict:
        self.config = J.merged_config(self.config, submitted)
        return {"saved": True, "fields_updated": [k for k, v in submitted.items() if v]}

    def hot_index(self, confirm: bool) -> dict:
        if not confirm:
            raise ValueError("confirm is required")
        return {"ok": True, "rows": M.hot(self.engine.memories(), self.engine.table("memory_cognitive")).count()}

    def coverage(self) -> dict:
        live, vectors = M.live(self.engine.table("memories")), self.engine.table("memories_vec")
        n, v = live.count(), live.join(vectors, F.col("id") == F.col("memory_id"), "left_semi").count()
        return {"memories": n, "vectors": v, "coverage": 100 * v // max(1, n)}


OPEN: dict[tuple[str, str], Callable] = {
    ("GET", "healthz"): lambda a: {"status": "ok", "service": NAME}, ("GET", "readyz"): lambda a: a.engine.ready() | {"service": NAME},
    ("GET", "manifest"): lambda a: {"name": NAME, "version": VERSION, "endpoints": sorted(f"{m} /{p}" for m, p in ROUTES), "auth": {"type": "bearer"}},
}
ROUTES: dict[tuple[str, str], Callable] = {
    ("POST", "memory/store"): lambda a, p, w: {"memory_id": a.engine.store(p, w["principal"])}, ("POST", "memory/store-batch"): lambda a, p, w: {"ids": a.engine.store_batch(p["items"], w["principal"])},
    ("GET", "memory/get"): lambda a, p, w: a.engine.get(p["memory_id"], **w), ("GET", "memory/bundle"): lambda a, p, w: a.engine.bundle(p["bundle_id"], **w),
    ("GET", "memory/recall"): lambda a, p, w: {"items": a.engine.recall(**p)}, ("POST", "memory/edges"): lambda a, p, w: {"status": "ok", "edge": a.engine.add_edge(**p)},
    ("POST", "memory/consolidate"): lambda a, p, w: a.engine.consolidate(**p),
    ("POST", "memory/forget"): lambda a, p, w: {"status": a.engine.forget_one(**p)} if "memory_id" in p else {"status": "ok", "candidates": a.engine.forget(**p)},
    ("GET", "memory/constitution"): lambda a, p, w: {"version": "0", "content": a.engine.constitution()}, ("POST", "memory/constitution/propose"): lambda a, p, w: a.engine.propose(p["content"]),
    ("GET", "memory/review/due"): lambda a, p, w: {"items": a.engine.due(**p)}, ("POST", "memory/review/grade"): lambda a, p, w: a.engine.grade(p["memory_id"], p["grade"]),
    ("POST", "memory/review/enroll/*"): lambda a, p, w: {"memory_id": p["id"], "next_review_ts": a.engine.enroll(p["id"], p.get("initial_interval_days", 1))}, ("GET", "memory/review/stats"): lambda a, p, w: a.engine.review_stats(),
    ("POST", "memory/reindex-concepts"): lambda a, p, w: a.engine.reindex(), ("POST", "memory/fts-rebuild"): lambda a, p, w: {"fts_rows": a.engine.rebuild_postings()}, ("GET", "memory/concepts"): lambda a, p, w: {"items": a.engine.list_concepts(**p)},
    ("GET", "memory/connect"): lambda a, p, w: a.engine.connect_queries(**p) or {"connected": False}, ("GET", "memory/dangling"): lambda a, p, w: {"items": a.engine.list_dangling(**p)}, ("GET", "memory/recall-hybrid"): lambda a, p, w: {"items": a.engine.recall_hybrid(**p)},
    ("GET", "memory/relations"): lambda a, p, w: {"items": a.engine.relations(**p)}, ("GET", "memory/connect2"): lambda a, p, w: a.engine.connect_ranked(**p), ("POST", "memory/vec/backfill"): lambda a, p, w: {"embedded": a.engine.backfill_vectors(limit=p.get("limit", 0))},
    ("GET", "memory/vec/stats"): lambda a, p, w: a.coverage(), ("POST", "memory/sync-file-memories"): lambda a, p, w: a.sync(), ("POST", "memory/sleep-cycle"): lambda a, p, w: a.engine.nightly(vault=a.vault, **p),
    ("POST", "memory/invalidate"): lambda a, p, w: {"status": "ok", "memory_id": p["memory_id"], "done": a.engine.invalidate([p["memory_id"]])}, ("POST", "memory/supersede"): lambda a, p, w: a.engine.supersede_unchecked(p.get("old_id", ""), p.get("new_id", "")),
    ("GET", "memory/digest"): lambda a, p, w: a.engine.digest(**p), ("POST", "memory/governance/promote"): lambda a, p, w: a.engine.promote(principal=w["principal"], **p), ("POST", "memory/governance/activate"): lambda a, p, w: a.engine.activate(principal=w["principal"], **p),
    ("POST", "memory/recall-dream-seeds"): lambda a, p, w: {"items": a.engine.dream_seeds(**p, **w)}, ("POST", "memory/governance/dream-accessibility"): lambda a, p, w: a.engine.dream(p["dream_note_id"], p["dream_date"], [(m["memory_id"], m.get("phase_count", 1), m.get("segment_count", 1)) for m in p["mentions"]], **w),
    ("POST", "memory/governance/conflicts/review"): lambda a, p, w: {"status": a.engine.review_conflict(**p)}, ("POST", "memory/governance/supersede"): lambda a, p, w: {"shared_state_version": a.engine.supersede(**p)},
    ("POST", "memory/governance/nightly"): lambda a, p, w: {"promoted_to_M3": a.engine.promote_nightly(**p)}, ("POST", "memory/cognitive/backfill"): lambda a, p, w: a.engine.backfill_governance(**p), ("POST", "memory/governance/rebuild-hot-index"): lambda a, p, w: a.hot_index(bool(p.get("confirm"))),
    ("POST", "memory/hippocampus/stage"): lambda a, p, w: {"episode_id": a.engine.stage(**p)}, ("POST", "memory/hippocampus/promote"): lambda a, p, w: {"updated": a.engine.settle(**p)}, ("GET", "memory/hippocampus"): lambda a, p, w: a.engine.inbox_status(**p),
    ("POST", "memory/recall-planned"): lambda a, p, w: a.engine.recall_planned(**p, **w), ("GET", "memory/cognitive/stats"): lambda a, p, w: a.engine.stats(),
    ("POST", "backup/run/*"): lambda a, p, w: a.back_up(p["id"]), ("GET", "backup/restore/*"): lambda a, p, w: a.engine.restore(p["id"], a.key), ("POST", "backup/retry"): lambda a, p, w: a.retry(), ("GET", "backup/stats"): lambda a, p, w: {"pools": J.shard_stats(a.engine.table("shards")).collect()},
    ("GET", "backup/config"): lambda a, p, w: {"configured": bool(a.config), "fields": {k: f"***{v[-4:]}" if len(v) >= 4 else "" for k, v in a.config.items()}}, ("POST", "backup/config"): lambda a, p, w: a.set_config(p),
}
