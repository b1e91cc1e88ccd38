"""No step broadcasts a table that grows with the input: the optimizer sees compressed files as far smaller than their rows."""

import pytest

from wirespan.plans import catalog, flows
from wirespan.sources import tables

SF = "/root/testdata/sf0.01"


def test_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    one, two = spark.range(50).toDF("k"), spark.range(50).toDF("k")
    join = lambda: tables.shared_table(one).join(tables.shared_table(two), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in join()
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 49)
    assert "SortMergeJoin" in join()


def test_counts_of_written_tables(spark):
    table, seen = tables.counted_table(spark.range(7).toDF("k"))
    assert (table.count(), seen) == (7, {})


@pytest.mark.parametrize("name", ["connection_summary", "suppressed_detections", "model_lines", "aux_lines"])
def test_steps_do_not_broadcast(spark, monkeypatch, name):
    """With tables that count as large, of all that the query writes and gives."""
    plans, counted = [], tables.counted_table

    def noted(df, **counts):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return counted(df, **counts)

    monkeypatch.setattr(tables, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(tables, "counted_table", noted)
    monkeypatch.setattr(flows, "counted_table", noted)
    plans.append(catalog.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [line for p in plans for line in p.splitlines() if "Broadcast" in line]
