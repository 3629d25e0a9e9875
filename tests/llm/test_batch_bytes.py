from pyspark.sql import functions as F

from docintake.llm.common import bound_batches


def test_batches_to_python_stay_small(spark):
    """24 MB of texts in one task arrive in pieces of a few MB, as a task holds a batch several times."""
    bound_batches(spark)
    rows = spark.range(0, 384, 1, 1).select(F.repeat(F.lit("x"), 65_536).alias("text"))
    sizes = rows.mapInArrow(lambda batches: (b.slice(0, 0).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r[0] for r in sizes) <= 6 << 20
    assert sum(r[0] for r in sizes) >= 384 * 65_536
