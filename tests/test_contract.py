"""The driver's contract: entry, queries and their SQL agree."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def sql_rows(sf_dir, sql):
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = db.execute(sql)
        return [c[0] for c in result.description], result.fetchall()


#: The queries beside those of the optional modules, which have tests of their own.
OWN = {k: q for k, q in contract.queries().items() if q.__module__ == "__spark_entry__"}


def test_every_query_has_sql():
    assert OWN.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()


def test_without_the_optional_modules(monkeypatch):
    for name in ("quillon.llm", "quillon.llm.queries", "quillon.llm.sql", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert contract.queries().keys() == contract.oracle_sql().keys() == OWN.keys()


def test_without_the_subpackage_alone(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("quillon.llm.")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "quillon.llm", None)
    assert contract.queries().keys() == contract.oracle_sql().keys() == OWN.keys()


def test_a_broken_optional_module_is_not_hidden(monkeypatch, tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError, match="no_such_module"):
        contract.queries()


def test_entry_returns_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["n_nationkey", "n_name", "revenue"]
    assert df.count() == 25


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = contract.queries()[name](spark, sf_dir)
    columns, rows = sql_rows(sf_dir, contract.oracle_sql()[name])
    assert df.columns == columns
    assert rows
    assert [tuple(r) for r in df.collect()] == rows


def test_bench_prints_one_json_line():
    chosen = {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": " ".join(OWN)}
    run = subprocess.run(
        [sys.executable, "bench.py"],
        cwd=ROOT,
        env={**os.environ, **chosen},
        capture_output=True,
        text=True,
        timeout=300,
        check=True,
    )
    (line,) = run.stdout.splitlines()
    report = json.loads(line)
    assert report["sf"] == "0.001"
    assert report["queries"].keys() == OWN.keys()
    assert report["value"] > 0
