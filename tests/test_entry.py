import __spark_entry__ as entry_point
from sketchweave.plans import registry


def test_registered_names():
    q, o = entry_point.queries(), entry_point.oracle_sql()
    assert registry.QUERIES.keys() <= q.keys() and o.keys() <= q.keys()


def test_core_does_not_import_the_corpus_operators():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "llm" not in path.read_text(), path


def test_tables_go_to_a_shared_folder_or_nowhere(monkeypatch):
    import types

    import pytest

    from sketchweave.streaming.storage import scratch

    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch(cluster)
