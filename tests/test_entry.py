import importlib
import sys

import __spark_entry__ as entry
from loamstone.plans import registry


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert registry.FLAGSHIP in q and set(o) <= set(q) and all(callable(f) for f in q.values()) and not any("{" in s and "}" in s and "'{" not in s and "{documents}" in s for s in o.values())


def test_core_stands_without_the_corpus_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("loamstone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "loamstone.llm", None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(registry.queries()) and set(fresh.oracle_sql()) == set(registry.oracle_sql())
