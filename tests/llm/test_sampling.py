import pytest

from tallybook.llm.sampling import at_most


@pytest.mark.parametrize("rows, n", [(0, 5), (3, 5), (2000, 100), (2000, 5000)])
def test_bounded_and_repeatable(spark, rows, n):
    df = spark.range(rows).withColumnRenamed("id", "doc_id")
    one = [r.doc_id for r in at_most(df, n, rows, "doc_id").collect()]
    two = [r.doc_id for r in at_most(df.repartition(7), n, rows, "doc_id").collect()]
    assert one == two and len(one) == min(rows, n) and len(set(one)) == len(one)
