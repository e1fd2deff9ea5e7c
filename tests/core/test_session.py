import pytest
from pyspark.sql import functions as F

from jobloom import session


class _Conf:
    def get(self, *_):
        return None


class _Context:
    applicationId, master = "app-x", "spark://somewhere:7077"

    def getConf(self):
        return _Conf()


class _Session:
    sparkContext, conf = _Context(), _Conf()


def test_no_own_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.stage_root(_Session())


def test_staged_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "k int, v string").withColumn("e", F.array("v"))
    x = session.staged(df, "t")
    assert x.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, x.collect())) == [(1, None, [None]), (2, "a", ["a"])]
    assert session.stage_root(spark) == session.stage_root(spark) and spark.sparkContext.applicationId in session.stage_root(spark)
