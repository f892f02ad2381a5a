import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(where, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=where, capture_output=True, text=True, timeout=120, check=False)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["key", "value", "ts", "seq"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(tmp_path):
    for name in ("tidelog", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tidelog/llm", ignore_errors=True)
    done = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert len(q) > 35 and not any(n.startswith('op') for n in q); e.oracle_sql()")
    assert done.returncode == 0, done.stderr


def test_errors_inside_the_corpus_operators_are_not_hidden(tmp_path):
    for name in ("tidelog", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tidelog/llm", ignore_errors=True)
    (tmp_path / "tidelog/llm").mkdir()
    (tmp_path / "tidelog/llm/__init__.py").write_text("")
    (tmp_path / "tidelog/llm/registry.py").write_text("import a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in run(tmp_path, "import __spark_entry__ as e; e.queries()").stderr


def test_nothing_else_imports_them():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tidelog").parts:
            assert "llm" not in p.read_text()
