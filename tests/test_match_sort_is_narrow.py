"""The sort of all candidates of a match does not carry the map of weights, which is the same for every row of a case."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_weights_are_not_sorted(spark):
    plan = entry.queries()["match_breakdown"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [row_number") :].splitlines()
    sorted_columns = next(line for line in below if "Project [" in line)
    columns = sorted_columns.split("Project [")[1]
    assert "axis_stage" in columns
    assert not any(part.strip().startswith("weights#") for part in columns.split(", "))
