from __future__ import annotations

import re

from quillspark.llm import queries


def test_license_scan_has_no_python(spark):
    p = queries.op1_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Cartesian", p) and "BroadcastHashJoin" in p
