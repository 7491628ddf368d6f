"""Every catalogue query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from barlume.plans import catalogue, services  # noqa: F401
from tests.conftest import DATA

SF = DATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows: list[dict]) -> list[tuple]:
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(show(r[k]) for k in sorted(r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = [r.asDict() for r in catalogue.queries()[name](spark, str(SF)).collect()]
    told = duck.sql(catalogue.oracle_sql()[name])
    want = [dict(zip(told.columns, r, strict=True)) for r in told.fetchall()]
    assert len(found) == len(want)
    a, b = canonical(found), canonical(want)
    near = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 * max(1, abs(x))
    assert all(len(x) == len(y) and all(map(near, x, y)) for x, y in zip(a, b, strict=True))


def test_entry_imports_without_training_data_operators(tmp_path):
    """The entry module and the catalogue work where the llm folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(ROOT / "barlume", tmp_path / "barlume", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
