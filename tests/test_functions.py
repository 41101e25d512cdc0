import pytest
from pyspark.sql import functions as F

from quern.functions.values import pull, push, shown
from quern.operators import stats


@pytest.mark.parametrize("value, want", [(3.0, "3"), (-2.0, "-2"), (2.5, "2.5"), (0.1, "0.1"), (1234567.5, "1.23457e+06"), (1e-7, "1e-07"), (100000.0, "100000")])
def test_numbers_as_text(spark, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(shown(F.col("x"))).first()[0] == want


def test_lists(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a, b,,a",)], "x string")
    assert [r[0] for r in df.select(push(F.col("x"), "a")).collect()] == ["a", "a", "a,a", "a, b,,a,a"]
    assert [r[0] for r in df.select(pull(F.col("x"), "a")).collect()] == [None, "", "", "b"]


def test_histogram_of_few_and_no_values(spark):
    df = spark.createDataFrame([(float(i),) for i in (5, 1, 3)] + [(None,)], "x double")
    assert [r["bound"] for r in stats.histogram(df, "x", 3).orderBy("bucket").collect()] == [1.0, 3.0, 5.0]
    assert len(stats.histogram(df, "x", 8).collect()) == 8
    assert stats.histogram(df.limit(0), "x").count() == 0
    assert stats.quick_histogram(df, "x", 3).count() == 3
    assert stats.quick_frequent(df, "x", 2).count() >= 1
    assert stats.join_size(df, df, "x", "x").first()["rows"] > 0
