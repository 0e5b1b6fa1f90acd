"""What the plans of the registered queries must and must not contain."""

import json

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from __spark_entry__ import entry
from viewloom import Dashboard, GraphSpec, HierarchySpec, LinkSpec, SeriesSpec
from viewloom.operators import hierarchy, staging
from viewloom.sources.records import read_records
from workload.oracle import ORACLE
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
NEVER = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"]


@pytest.fixture
def plans(monkeypatch):
    """Plans of all frames that are stored or collected while a query is built."""
    seen = []

    def recorded(name):
        original = getattr(DataFrame, name)

        def wrapper(self, *args, **kwargs):
            seen.append(self._jdf.queryExecution().executedPlan().toString())
            return original(self, *args, **kwargs)

        monkeypatch.setattr(DataFrame, name, wrapper)

    for name in ("collect", "count"):
        recorded(name)
    write = DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        seen.append(explained(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_and_no_python(spark, plans, name):
    df = QUERIES[name](spark, FOLDER)
    for plan in [*plans, explained(df)]:
        assert not [word for word in NEVER if word in plan], plan


@pytest.mark.parametrize("name", ["link_matrix", "graph_nodes", "graph_links_numeric", "series_bars"])
def test_first_and_last_row_aggregates_hash(spark, plans, name):
    df = QUERIES[name](spark, FOLDER)
    assert not [p for p in [*plans, explained(df)] if "SortAggregate" in p]


@pytest.mark.parametrize("order", [["row_order"], ["part", "place"]])
def test_records_of_files_fold_without_a_sort(spark, plans, tmp_path, order):
    """All five views over JSON Lines in several files, by the reader's order and by two columns."""
    for part in range(3):
        lines = [{"part": part, "place": i, "c": "ab"[i % 2], "v": i, "l": ["a", "c"], "n": i % 4} for i in range(20)]
        (tmp_path / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in lines))
    schema = "part int, place bigint, c string, v double, l array<string>, n int"
    df = read_records(spark, str(tmp_path), lines=True, schema=schema)
    spec = HierarchySpec(["n", "c"], "v", order)
    board = Dashboard(df, SeriesSpec("c", "v", order), LinkSpec("c", "l", order), GraphSpec("c", "l", "v", order), spec)
    shown = [board.bars(), board.ribbons(), board.nodes, board.graph_links, hierarchy.leaves(df, spec), board.tree]
    assert all(f.count() for f in shown)
    assert len(plans) > 6 and not [p for p in [*plans, *map(explained, shown)] if "SortAggregate" in p]


def test_layout_stores_two_tables(spark, monkeypatch):
    stored = []
    original = staging.scratch
    monkeypatch.setattr(staging, "scratch", lambda session, name: stored.append(name) or original(session, name))
    QUERIES["tree_partition"](spark, FOLDER)
    assert len(stored) <= 2
    stored.clear()
    QUERIES["key_dictionary"](spark, FOLDER)
    assert len(stored) <= 7  # one for each of three views, two for the tree, one for the dictionary


def test_scans_are_pruned_and_filters_pushed(spark, plans):
    explained(QUERIES["tree_subtree"](spark, FOLDER))
    base = plans[0]
    assert "EqualTo(r_name,EUROPE)" in base
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double,c_mktsegment:string>" in base
    plans.clear()
    QUERIES["link_matrix"](spark, FOLDER)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plans[0]
    assert sum("lineitem.parquet" in p for p in plans) == 1  # one pass over the records


def test_every_query_has_sql_and_the_flagship_runs(spark):
    assert set(QUERIES) == set(ORACLE)
    con = duckdb.connect()
    for name in ("nation", "supplier", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = sorted(con.execute(ORACLE["link_matrix"]).fetchall())
    assert sorted(tuple(r) for r in entry(spark).collect()) == want


def test_checkpoint_folder_is_the_session_s(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured and staging.checkpoint_folder(spark).startswith(("file:" + configured, configured))
