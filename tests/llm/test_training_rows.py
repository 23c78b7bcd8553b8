"""Rows that toxicity learns from."""

from pyspark.sql import functions as F

from vacantia.llm import toxicity


def test_an_id_that_repeats_gives_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(2, None), (2, None), (3, "c"), (None, "d")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = [toxicity.training_rows(d, labels, lambda i: F.lit(True), 100).orderBy("doc_id").collect()
           for d in (docs, docs.orderBy(F.desc("text")))]
    assert [r.doc_id for r in got[0]] == [1, 2, 3] and got[0] == got[1]
    assert [(r.text, r.toxic) for r in got[0][1:]] == [("", 0), ("c", 0)]
