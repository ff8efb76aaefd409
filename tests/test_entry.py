"""The driver's contract holds with and without the training-data folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"


@pytest.mark.parametrize("gone", [(), ("geoweft/llm",), ("geoweft/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_folders(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    n, known, pipeline, llm = out.stdout.split()
    here = (REPO / "geoweft/llm").exists() and "geoweft/llm" not in gone
    assert int(n) >= 60 and known == "True" and llm == str(here)
    assert pipeline == str(here and (REPO / "corpus_pipeline.py").exists() and "corpus_pipeline.py" not in gone)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from geoweft.functions import lineage

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.cut(Frame())
