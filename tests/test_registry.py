"""Registered queries against their SQL twins, and the subpackage's absence."""

import ast
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

from lagoon.plans import queries as registry

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return None if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    where = [names.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in where]) for r in found.fetchall())


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "lagoon").rglob("*.py"):
        if path.parent.name != "llm":
            for node in ast.walk(ast.parse(path.read_text())):
                module = getattr(node, "module", None) or ""
                names = [a.name for a in getattr(node, "names", [])] if isinstance(node, ast.Import | ast.ImportFrom) else []
                assert not any("llm" in x for x in [module, *names]), path


def test_the_rest_imports_without_the_corpus_subpackage(tmp_path):
    """On a copy without the subpackage and the pipeline the session queries are all there."""
    for name in ("__spark_entry__.py", "lagoon"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}).stdout.split()
    assert told == [str(len(registry.QUERIES)), str(len(registry.ORACLE)), "False"]
