"""The entry point, with and without the optional part; every registered query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "sum_qty", "n"]


def test_without_optional_part(tmp_path):
    shutil.copytree(REPO / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]") and int(out.split()[0]) > 40


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.registry.ORACLES))
def test_against_sql(spark, base, name):
    df = entry.queries()[name](spark, DATA)
    got = base.execute(entry.oracle_sql()[name])
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(got.fetchall(), [c[0] for c in got.description])


@needs_data
def test_whole_sort_in_order(spark, base):
    got = [tuple(r) for r in entry.queries()["sort_multi_all"](spark, DATA).collect()]
    assert got == base.execute(entry.oracle_sql()["sort_multi_all"]).fetchall()
    assert len(got) >= base.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert got[0][2] is not None and got[-1][2] is None
