"""The run-off of categories needs one shuffle: a topic's labels are few and are listed by one aggregate."""

from topicloom.operators import pictures
from topicloom.plans import catalogue


def test_one_shuffle_and_no_window(spark, sf_dir):
    plan = catalogue.QUERIES["category_runoff"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_few_labels(spark):
    rows = [(1, "a", 0.7), (1, "b", 0.2), (2, "only", 0.5), (3, "a", 0.34), (3, "b", 0.33), (3, "c", 0.33), (4, "b", 0.5), (4, "a", 0.5), (4, "c", None)]
    got = {r["topic_id"]: (r["category_score"], r["category_runner_up_score"]) for r in pictures.runoff(spark.createDataFrame(rows, "topic_id long, label string, score double")).collect()}
    assert got == {1: (0.778, 0.222), 2: (1.0, 0.0), 3: (0.507, 0.493), 4: (0.5, 0.5)}
