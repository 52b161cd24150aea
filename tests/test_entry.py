"""The entry module without the training-data operators, and with broken ones."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(where):
    env = os.environ | {"PYTHONPATH": str(where), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", SHOW], cwd=where, env=env, capture_output=True, text=True, check=True)
    return json.loads(out.stdout.splitlines()[-1])


@pytest.mark.parametrize("broken", [None, "def f(:", "raise ValueError('no')", "import no_such_module"])
def test_entry_without_the_subpackage(tmp_path, broken):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if broken or name != "corpus_pipeline.py":
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if broken:
        (tmp_path / "lectern/llm").mkdir()
        (tmp_path / "lectern/llm/__init__.py").write_text("")
        (tmp_path / "lectern/llm/queries.py").write_text(broken)
    queries, oracle = names(tmp_path)
    assert len(queries) > 150 and set(oracle) <= set(queries)
    assert not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in queries)
