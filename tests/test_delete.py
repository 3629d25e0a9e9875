"""Deletion holds tables against hash tables of what goes: no task sorts its part of a table."""

import pytest

from docintake.operators import lifecycle


@pytest.fixture(scope="module")
def left(spark):
    docs = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c"), (4, None, None)], "document_id long, origin_id long, content_hash string")
    originals = spark.createDataFrame([(10, "o10"), (11, "o11"), (12, "o12")], "origin_id long, hash string")
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, "o11"), (5, "o10"), (6, None), (7, "b")], "job_id long, hash string")
    child = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "z")], "document_id long, name string")
    ids = spark.createDataFrame([(1,), (1,), (3,), (99,), (None,)], "document_id long")
    return lifecycle.delete_documents(ids, docs, originals, jobs, {"child": child})


def test_what_remains(left):
    found = {name: sorted((r[0] for r in df.select({"child": "name", "documents": "document_id", "originals": "origin_id", "jobs": "job_id"}[name]).collect()), key=str) for name, df in left.items()}
    assert found == {"documents": [2, 4], "originals": [10, 12], "jobs": [5, 6, 7], "child": ["x", "z"]}


@pytest.mark.parametrize("name", ["documents", "originals", "jobs", "child"])
def test_no_table_is_sorted(left, name):
    plan = left[name]._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
