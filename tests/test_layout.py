"""The training-data subpackage stays apart."""

from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_nothing_else_imports_it():
    rest = [p for p in (ROOT / "loomtrace").rglob("*.py") if "llm" not in p.relative_to(ROOT / "loomtrace").parts]
    assert rest and not [p for p in [*rest, ROOT / "bench.py"] if "loomtrace.llm" in p.read_text()]


def test_queries_without_it(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", None)
    assert entry.queries() and set(entry.oracle_sql()) == set(entry.queries())
