"""Plans keep their shape, and every registered query agrees with its SQL."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from catalog.metrics import metrics_of
from catalog.standins import daily, hourly, raw_observations
from murmur.operators import ingest as ig
from murmur.operators import metrics as mt
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_one_shuffle_serves_all_baselines(spark):
    metrics = spark.createDataFrame([], metrics_of(daily(spark, SF)).schema)
    text = plan(mt.metric_signals(metrics))
    assert text.count("Exchange") <= 2 and "CartesianProduct" not in text


def test_scans_read_only_what_they_need(spark):
    d = daily(spark, SF)
    text = plan(mt.platform_metrics(d.content, d.content_topic, d.content_asset, d.asset_topic, d.analysis, size="1d"))
    assert "o_orderpriority" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_newest_version_is_a_partial_aggregate(spark):
    text = plan(ig.latest_versions(raw_observations(spark, SF)))
    assert "partial_max_by" in text and "Window" not in text


def test_no_python_in_the_aggregates(spark):
    d = hourly(spark, SF)
    text = plan(mt.metric_signals(metrics_of(d)))
    assert "Python" not in text and "Arrow" not in text


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(rows, df.columns, result.fetchall(), columns) == "ok"


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() >= 0


@pytest.mark.parametrize("name", ["a10_source_status", "a17_task_summary", "r03_post_page", "r05_source_coverage", "f03_entity_links", "j13_asof_entry", "x29_folded_content"])
def test_no_cross_joins(spark, name):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_functions_reach_workers_without_the_package(tmp_path):
    """A session started from another folder, whose workers cannot import the package."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(entry.__file__).resolve().parent)
    code = (
        f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from murmur.session import local_session; s = local_session('2');"
        f"print([e.queries()[q](s, {SF!r}).count() for q in ('x01_html_to_text', 'x12_normalized_text', 'j14_near_duplicates')])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("[50, 200, 200]"), done.stderr[-800:]
