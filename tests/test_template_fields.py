"""Documents are not brought together by template: a handful of templates would be as many tasks."""

from docintake.config import TemplateField
from docintake.operators import fields


def test_documents_stay_where_they_are(spark):
    table = fields.template_fields_table(spark, {1: [TemplateField("Número", required=True), TemplateField("valor")], 2: [TemplateField("x")]})
    rows = [(1, 1, {"numero": "5"}), (2, 1, {"valor": "7"}), (3, 2, {}), (4, 9, {"numero": "8"}), (5, None, {})]
    docs = spark.createDataFrame(rows, "document_id long, template_id long, pairs map<string,string>")
    mapped = fields.map_fields(docs, table)
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {(r.document_id, r.field_no): (r.name, r.raw, r.missing_required) for r in mapped.collect()}
    assert got == {(1, 0): ("Número", "5", False), (1, 1): ("valor", None, False), (2, 0): ("Número", None, True), (2, 1): ("valor", "7", False), (3, 0): ("x", None, False)}
