from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_folder(monkeypatch):
    def gone(name, real=entry.importlib.import_module):
        if name == "corpus_pipeline" or name.startswith("ledgerlark.llm"):
            raise ModuleNotFoundError(f"No module named '{name}'", name="ledgerlark.llm")
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    names = entry.queries()
    assert "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert len(names) > 70


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "ledgerlark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "ledgerlark.llm" not in p.read_text(), p
    assert "ledgerlark" in sys.modules
