import os
import re

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 80


@here
def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "attack_pattern" in df.columns


@here
@pytest.mark.parametrize("name", ["session_features", "ssh_incidents", "generic_incidents", "apache_report"])
def test_plans_have_no_cross_joins_and_read_one_pruned_table(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "value:double" not in "".join(re.findall(r"ReadSchema: \S+", plan))
