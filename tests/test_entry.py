"""The rest of the library stands without the subpackage for training data."""

import os
import re
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources():
    for at, dirs, names in os.walk(os.path.join(ROOT, "tessera")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(at, n)) as f:
                    yield n, f.read()


def test_nothing_else_imports_the_subpackage():
    for name, text in sources():
        assert not re.search(r"(from|import)\s+[\w.]*llm|corpus_pipeline", text), name


def test_entry_works_without_it(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tessera"), tmp_path / "tessera", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "id", "score", "vector_score", "keyword_score", "rank"] and rows.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
