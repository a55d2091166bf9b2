"""The registered queries: names, oracles, and that the rest works without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_without_the_llm_folders(tmp_path):
    to = tmp_path / "repo"
    # with and without corpus_pipeline.py beside them
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, timeout=100)
    (to / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, timeout=100)
