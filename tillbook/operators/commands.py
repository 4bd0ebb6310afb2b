"""Several commands on one target in one batch. The source handles commands
one after the other; a bulk job gets the same result by keeping one command
per target (``one_per_target``) or by chaining the commands of a target in
order (``in_sequence``). Order: command time, then the other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_per_target(cmds: DataFrame, key: str, ts: str | None = None, keep: str = "first") -> DataFrame:
    """The first (or last) command of each ``key``: an aggregate with map-side
    combine, so a command delivered many times is reduced before the shuffle."""
    rest = ([ts] if ts else []) + [c for c in cmds.columns if c not in (key, ts)]
    if not rest:
        return cmds.select(key).distinct()
    pick = F.min if keep == "first" else F.max
    return cmds.groupBy(key).agg(pick(F.struct(*rest)).alias("_cmd")).select(key, "_cmd.*")


def in_sequence(key: str, ts: str, *tie: str) -> WindowSpec:
    """Window over the commands of one target in their order."""
    return W.partitionBy(key).orderBy(ts, *tie)
