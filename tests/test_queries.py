"""Every registered query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 6) + 0.0)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return str(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_entry_runs(spark):
    r = entry.entry(spark).first()
    assert r["n"] > 0 and 0 < r["mrr"] <= 1


def test_names_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"title_fuzzy_lookup"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fuzzy_lookup_equals_difflib(spark):
    import difflib
    import re

    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = {norm(r.text): r.item_id for r in rows}
    want = {}
    for r in rows:
        t = norm(re.sub(r"^\S+\s+", "", r.text, count=1))
        best = max(((difflib.SequenceMatcher(None, t, k, autojunk=False).ratio(), -i, i) for k, i in index.items()))
        if best[0] >= 0.85:
            want[r.item_id] = best[2]
    got = {r.title_id: r.paper_id for r in QUERIES["title_fuzzy_lookup"](spark, SF).collect()}
    assert got == want


def test_library_stands_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in ("lattica", "__spark_entry__.py"):
        src = f"{root}/{p}"
        shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
