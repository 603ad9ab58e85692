import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(at):
    """Of the queries that a copy of the library registers, in a process of its own."""
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return set(subprocess.run([sys.executable, "-B", "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, check=True).stdout.split())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{HERE}/{name}"):
            shutil.copy(f"{HERE}/{name}", tmp_path)
    shutil.copytree(f"{HERE}/veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    bare = names(tmp_path)
    assert "detect_documents" in bare and "pipeline" not in bare and not [x for x in bare if x.startswith("op")]
    assert bare == {x for x in names(HERE) if x != "pipeline" and not x.startswith("op")}
    if os.path.exists(tmp_path / "corpus_pipeline.py"):
        os.remove(tmp_path / "corpus_pipeline.py")
        assert names(tmp_path) == bare
