"""Segmented scans over rows dealt by range.

Rows are cut into ranges of (account, time, tie) of about equal size, so an
account, a day or a second that holds most rows is spread over tasks like any
other. A scan then has three steps: inside each range (window per range and
account), over one summary row per range and account (the carry), and the
carry applied to the range's rows. A summary has at most as many rows as there
are ranges, plus one per account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.session import cut_lineage

RANGE = "_range"
# ranges per shuffle partition: ranges are dealt to tasks by hash, some to each
RANGES_PER_TASK = 4


def dealt_by_range(rows: DataFrame, keys: list[str], ordering: list[str]) -> DataFrame:
    """``rows`` with the number of their range (column ``_range``). The numbers
    follow from a sample of the rows, so they are fixed by a reliable
    checkpoint: every step of a scan must see the same ones. Runs a job."""
    n = RANGES_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(n, *keys, *ordering).withColumn(RANGE, F.spark_partition_id()))


def within_range(keys: list[str], ordering: list[str], *more: str):
    """Running frame over the rows of a range and account."""
    return (W.partitionBy(RANGE, *keys, *more).orderBy(*ordering).rowsBetween(W.unboundedPreceding, W.currentRow))


def with_carry(rows: DataFrame, summary: DataFrame, keys: list[str], carry: dict[str, Column]) -> DataFrame:
    """``rows`` joined with the columns ``carry`` of their range and account's
    row of ``summary`` (one row per range and account)."""
    names = {k: f"_s{i}" for i, k in enumerate([RANGE, *keys])}
    side = summary.select(*[F.col(k).alias(v) for k, v in names.items()], *[c.alias(n) for n, c in carry.items()])
    cond = F.lit(True)
    for k, v in names.items():
        cond = cond & rows[k].eqNullSafe(F.col(v))
    return rows.join(side, cond, "left").drop(*names.values())


def interval_sums(facts: DataFrame, spans: DataFrame, account: str, group: str, sums: dict[str, Column], ts: str,
                  span_id: str, start: str, end: str) -> DataFrame:
    """Per span (an account's interval, both ends inclusive) and group: the
    ``sums`` over the facts in it and their number ``n``; groups without a fact
    give no row. Spans may overlap as they like: no fact is paired with a span.
    A prefix sum per (account, group) over time answers both ends of every
    span, and the answer is their difference, so the work is one scan over the
    facts and two probes per span and group. Facts without a time are in no
    span. Null groups are a group."""
    f = facts.select(F.col(account).alias("_a"), F.col(group).alias("_g"), F.col(ts).cast("timestamp_ntz").alias("_t"),
                     F.lit(1).alias("_o"), F.xxhash64(*facts.columns).alias("_h"),
                     *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()], F.lit(1).cast("long").alias("n"))
    f = f.filter("_a is not null and _t is not null")
    cells = f.select("_a", "_g").distinct()
    ends = F.explode(F.array(F.struct(F.col(start).cast("timestamp_ntz").alias("t"), F.lit(0).alias("o")),
                             F.struct(F.col(end).cast("timestamp_ntz").alias("t"), F.lit(2).alias("o"))))
    probes = spans.select(F.col(span_id).alias("_id"), F.col(account).alias("_pa"), ends.alias("_e")).filter("_e.t is not null")
    probes = probes.join(cells, probes["_pa"] == cells["_a"]).select(
        "_a", "_g", F.col("_e.t").alias("_t"), F.col("_e.o").alias("_o"), F.xxhash64("_id").alias("_h"), "_id")
    keys, ordering = ["_a", "_g"], ["_t", "_o", "_h"]
    names = [*sums, "n"]
    rows = dealt_by_range(f.unionByName(probes, allowMissingColumns=True), keys, ordering)
    for n in names:
        rows = rows.withColumn(f"_r_{n}", F.sum(n).over(within_range(keys, ordering)))
    # what each range adds, and from it the sums before it
    adds = rows.groupBy(RANGE, *keys).agg(*[F.sum(n).alias(n) for n in names])
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    adds = adds.select(RANGE, *keys, *[F.sum(n).over(before).alias(f"_b_{n}") for n in names])
    found = with_carry(rows.filter(F.col("_id").isNotNull()), adds, keys, {f"_b_{n}": F.col(f"_b_{n}") for n in names})
    sign = F.when(F.col("_o") == 2, 1).otherwise(-1)
    both = found.groupBy(F.col("_id").alias(span_id), F.col("_g").alias(group)).agg(*[
        F.sum(sign * (F.coalesce(f"_r_{n}", F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0)))).alias(n) for n in names],
        F.count("*").alias("_ends"))
    return both.filter("_ends = 2 and n > 0").drop("_ends")
