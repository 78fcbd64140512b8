"""The native operators run no Python on executors, and none of the queries has a cartesian product."""

import re

import pytest

from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_mixing", "op9_quality_rules", "op10_exact_dedup"])
def test_native(spark, name):
    text = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", text)
