from docintake.llm import pii


def test_rows_made_do_not_depend_on_terms(spark):
    docs = spark.createDataFrame([("a b b c",), ("A d",), (None,), ("",)], "text string")
    for terms, want in ((["a"], ["a", "a"]), (["a", "b", "x"], ["a", "a", "b"]), ([], []), (None, ["a", "a", "b", "c", "d"])):
        rows = pii.term_rows(docs, terms)
        assert sorted(r.term for r in rows.collect()) == want
        made = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
        assert all(" IN " not in line and "filter(" not in line for line in made)
