"""Hand-made time cases (mixed offsets, hour 24, naive text)."""

import datetime as dt

from tillbook.functions.timeparse import business_day, normalize_ts


def test_normalize_and_business_day(spark):
    df = spark.createDataFrame([("2026-04-01 19:00:00-06:00",), ("2026-04-02 01:00:00",),
                                ("2026-04-01 24:05:00-06:00",), (None,)], "t string")
    rows = df.select(normalize_ts("t").alias("u"), normalize_ts("t", "America/Tegucigalpa").alias("u2"),
                     business_day(normalize_ts("t")).alias("d")).collect()
    assert rows[0].u == dt.datetime(2026, 4, 2, 1, 0) and rows[0].d == dt.date(2026, 4, 1)
    assert rows[1].u == dt.datetime(2026, 4, 2, 1, 0) and rows[1].u2 == dt.datetime(2026, 4, 2, 7, 0)
    assert rows[2].u == dt.datetime(2026, 4, 1, 6, 5)
    assert rows[3].u is None


def test_zulu_suffix_and_fractions(spark):
    texts = ["2026-04-02T01:00:00Z", "2026-04-02 01:00:00.25Z", "2026-04-01T19:00:00.123456-06:00", "2026-04-02 01:00:00.1234567", "x.5Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.u, r.z) for r in df.select("i", normalize_ts("t").alias("u"), normalize_ts("t", "America/Tegucigalpa").alias("z")).collect()}
    at = dt.datetime(2026, 4, 2, 1, 0)
    assert got[0] == (at, at)  # the suffix wins over the naive zone
    assert got[1][0] == at.replace(microsecond=250_000) and got[2][0] == at.replace(microsecond=123_456)
    assert got[3] == (at.replace(microsecond=123_456), dt.datetime(2026, 4, 2, 7, 0, 0, 123_456)) and got[4] == (None, None)
