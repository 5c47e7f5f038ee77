"""Registered queries against their SQL on the smallest tables; the entry without the llm folders."""

import math
import os
import subprocess
import sys

import pytest

DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

from spanloom import catalog  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def _key(rows):
    def norm(v):
        return "~" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = duck.execute(catalog.ORACLE_SQL[name])
    head = [d[0] for d in rel.description]
    assert sorted(head) == cols
    want = [tuple(r[head.index(c)] for c in cols) for r in rel.fetchall()]
    assert _key(got) == _key(want)


def test_entry_without_the_training_data_folder(tmp_path):
    import shutil

    for f in ("__spark_entry__.py",):
        shutil.copy(f"{ROOT}/{f}", tmp_path)
    shutil.copytree(f"{ROOT}/spanloom", tmp_path / "spanloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op1_') or x == 'pipeline' for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
