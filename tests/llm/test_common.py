import os

from tallyspark.llm import common


def test_cut_and_release(spark, documents):
    docs = common.cut(documents(["a", None]), "x")
    assert docs.count() == 2
    path = docs.inputFiles()[0].removeprefix("file:")
    common.release(spark)
    assert not os.path.exists(os.path.dirname(path))


def test_labelled_sample(spark):
    rows = [(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    some = common.labelled_sample(labels, 20).collect()
    assert len(some) == 20 and len({r.doc_id for r in some}) == 20 and some == common.labelled_sample(labels.repartition(5), 20).collect()


def test_light(spark):
    small = common.light(spark.range(10))
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
