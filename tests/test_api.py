import pytest

from loamstone.api import Api, Refused, principal_of, token_key
from loamstone.engine import Engine
from loamstone.operators import jobs as J


def test_principals():
    tokens = {token_key("t2"): {"id": "eve", "roles": ["r", " "]}}
    agents = {"bot": {"token_hashes": [token_key("t2")], "roles": ["x"]}}
    who = lambda *a: principal_of(*a, {"id": "jim"}, tokens, agents)
    assert who("t1", "") == {"type": "user", "id": "jim", "roles": [], "source": "default_token"}
    assert (who("t2", "")["id"], who("t2", "")["roles"]) == ("eve", ["r"]) and who("t2", "bot") == {"type": "agent", "id": "bot", "roles": ["x"], "source": "agent_map"}
    with pytest.raises(Refused):
        who("t1", "bot")
    with pytest.raises(Refused):
        principal_of("t", "", {}, {}, {})


def test_calls(spark, tmp_path):
    api = Api(Engine(spark, str(tmp_path / "db"), lambda: 1_700_000_000, owner="jim"), "t", key="k", pools=J.Pools({"gist": lambda n, b: n}))
    call = lambda m, p, **k: api.call(m, p, k, "t")
    assert api.call("GET", "/healthz")[0] == 200 and api.call("GET", "/readyz")[1]["status"] == "degraded" and len(api.call("GET", "/manifest")[1]["endpoints"]) >= 49
    assert api.call("GET", "/memory/stats", {}, "bad")[0] == 401 and call("GET", "/memory/nothing")[0] == 404 and api.call("GET", "/memory/concepts", {}, "t", "bot")[0] == 403
    status, body = call("POST", "/memory/store", kind="semantic", content="alpha_term is here", importance=4, meta={"source_id": "s"})
    mid = body["memory_id"]
    assert status == 200 and call("GET", "/memory/get", memory_id=mid)[1]["content"] == "alpha_term is here" and call("GET", "/memory/get", memory_id="no")[0] == 404
    assert call("GET", "/memory/recall", query="ALPHA", k=3)[1]["items"][0]["id"] == mid and call("POST", "/memory/store-batch", items=[])[0] == 400
    assert call("POST", "/memory/supersede", old_id="a", new_id="b")[0] == 409 and call("POST", "/memory/governance/rebuild-hot-index")[0] == 400 and call("POST", "/memory/governance/rebuild-hot-index", confirm=True)[1]["rows"] == 1
    assert call("POST", "/memory/review/enroll/no")[0] == 404 and call("GET", "/memory/review/stats")[1]["total"] == 1
    assert call("POST", f"/backup/run/{mid}")[1]["pending"] == 4 and call("POST", "/backup/run/no")[0] == 404 and call("GET", "/backup/restore/no")[0] == 404 and mid in call("GET", f"/backup/restore/{mid}")[1]["record"]
    api.pools = J.Pools({p: lambda n, b: n for p in J.POOLS})
    assert call("POST", "/backup/retry")[1]["pending"] == 0
    assert call("POST", "/backup/config", GITEE_TOKEN="secret1234", OTHER="")[1]["fields_updated"] == ["GITEE_TOKEN"] and call("GET", "/backup/config")[1]["fields"] == {"GITEE_TOKEN": "***1234"}
    assert call("GET", "/memory/vec/stats")[1] == {"memories": 1, "vectors": 0, "coverage": 0} and call("POST", "/memory/sync-file-memories")[1]["synced"] == 0
    assert call("POST", "/memory/hippocampus/stage", key="k", summary="password: x12345")[0] == 400 and call("GET", "/memory/recall", nonsense=1)[0] == 400
