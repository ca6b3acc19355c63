"""The entry module, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_has_a_name_and_sql_belongs_to_queries():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert len(queries) > 150 and set(entry.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_subpackage(tmp_path, pipeline):
    """Whether the pipeline's file has gone with the subpackage or not."""
    for name in ("quern", "__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists())):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'standard_scaler' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_flagship_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "f0", "f1", "f2", "f3"]
