import importlib
import subprocess
import sys

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_import_needs_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0])
    assert out.returncode == 0, out.stderr


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["pattern", "n_keys", "left_rows", "right_rows"] and out.count() > 0


def test_every_query_of_the_library_has_sql_and_runs():
    registry = importlib.import_module("lodestrata.plans.registry")
    assert len(registry.QUERIES) >= 70
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent / "lodestrata"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lodestrata.llm" in p.read_text()]
