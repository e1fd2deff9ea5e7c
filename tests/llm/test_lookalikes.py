from pyspark.sql import functions as F

from jobloom.llm.lookalikes import fold


def test_fold(spark):
    r = spark.createDataFrame([("Olá,  Ｍundo! C# é",), (None,), ("",), ("Invеstimentos\u200b ﬁm",)], "x string").select(fold(F.col("x")).alias("f")).collect()
    assert [x.f for x in r] == ["ola, mundo! c# e", None, "", "investimentos fim"]
