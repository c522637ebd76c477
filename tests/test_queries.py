"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lavra import registry
from lavra.plans.queries import TABLES

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in [*TABLES, "benchmark", "embeddings"]:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def tidy(rows, order):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rel = duck.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    assert tidy(df.collect(), [df.columns.index(n) for n in names]) == tidy(rel.fetchall(), [rel.columns.index(n) for n in names])


def test_layout_queries_read_all_blocks(spark):
    order = registry.queries()["reading_order"](spark, DATA)
    assert order.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["page_texts", "header_footer_long"])
def test_blocks_are_numbered_once(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1  # the blocks' texts are built and shuffled by one window; other passes read only places


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


def test_the_rest_works_without_the_subpackage(tmp_path):
    for part in ("lavra", "__spark_entry__.py"):
        at = REPO / part
        (shutil.copytree if at.is_dir() else shutil.copy)(at, tmp_path / part)
    shutil.rmtree(tmp_path / "lavra/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lang_detect' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True, timeout=120)
