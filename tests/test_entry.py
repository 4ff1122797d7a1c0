"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert {*o} <= {*q}; print('pipeline' in q, sum(n.startswith('op') for n in q), len(q), len(o))"


def asked(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()[-4:]


def test_queries_survive_the_deletion_of_the_corpus_operators(tmp_path):
    for name in ("receiptlake", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "receiptlake" / "llm", ignore_errors=True)
    pipeline, corpus, queries, oracles = asked(str(tmp_path))
    assert (pipeline, corpus) == ("False", "0") and int(queries) >= 76 and int(oracles) >= 76
    os.remove(tmp_path / "corpus_pipeline.py")
    assert asked(str(tmp_path))[:2] == ["False", "0"]
