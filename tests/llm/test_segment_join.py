"""The join of substring dedup that brings intervals back to the places of their segments."""

from flowtide.llm import substring


def test_intervals_of_a_segment_go_together(spark):
    """The places of a segment aren't multiplied by its intervals in a join."""
    df = spark.createDataFrame([(1, "a b", 5)], "id long, text string, text_hash long")
    plan = substring.find_repeats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(own") < plan.index("Join Inner")
