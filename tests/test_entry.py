"""The entry point imports, with all other queries, where the training-data folders are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "carsift", tmp_path / "carsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 150 and int(out[1]) > 150 and out[2] == "[]"
