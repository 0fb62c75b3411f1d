import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120).returncode == 0
