"""Queries that plant faults: every planted row shows, also where a key or an id is an odd one."""

from datetime import datetime

from tallyforge.plans.catalog import QUERIES

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp"


def tables(spark, path, orders):
    rows = [(key, customer, "O", 10.0, datetime(2024, 1, 1)) for key, customer in orders]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([], LINE).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_candidates_of_order_0_differ(spark, tmp_path):
    found = QUERIES["resolution_archive_faults"](spark, tables(spark, tmp_path, [(0, 2), (3, 2), (1, 3)])).collect()
    assert {r.fault: r.n for r in found} == {"candidates_differ": 2, "not_in_exactly_one_order": 1}


def test_an_id_without_letters_is_still_planted(spark, tmp_path):
    # The content id of this order's total has digits only, so its upper case is the id itself.
    found = QUERIES["event_faults"](spark, tables(spark, tmp_path, [(21432040, 1), (1, 1)])).collect()
    assert {r.rule: r.n for r in found} == {"id_follows_from_the_content": 1}


def test_rows_of_archive_digests_are_dealt_to_as_many_tasks_as_the_session_has(spark, tmp_path):
    plan = QUERIES["archive_digests"](spark, tables(spark, tmp_path, [(1, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan
