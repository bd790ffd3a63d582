"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["down", "main_id"] and df.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    for name in ("spindrift", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a4_main_pred' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
