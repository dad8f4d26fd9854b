"""What the scans must receive."""

import re

from runlens.sources.tables import scan_table

SF_DIR = "/root/testdata/sf0.001"


def test_scan_pushes_filter_and_columns(spark):
    df = scan_table(spark, f"{SF_DIR}/orders.parquet", ["o_orderkey"], {"o_orderstatus": "F"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert [c.split(":")[0] for c in read.split(",")] == ["o_orderkey", "o_orderstatus"]
