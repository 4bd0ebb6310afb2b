"""Exact cents beyond double precision, and default references."""

from decimal import Decimal

from pyspark.sql import functions as F

from tillbook.functions.money import round_cents


def test_round_cents_is_exact(spark):
    rows = [("9007199254740993.25",), ("123456789012345.67",), ("-0.005",), ("0.005",), ("-1.015",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(round_cents(F.col("t").cast("decimal(30,8)")).alias("r"))
    want = ["9007199254740993.25", "123456789012345.67", "0.00", "0.01", "-1.01", None]
    assert [r.r for r in df.collect()] == [w and Decimal(w) for w in want]
