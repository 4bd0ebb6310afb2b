"""Vector bin packing of documents into shards.

A group is all rows of one text. Its demand is the vector (bytes, tokens,
rows), each as a share of the whole. Groups go, largest first, to the shard
where the dot product of the demand with the residual capacity is highest.

Groups are sums of a map-side-combined aggregate, so a text with a third of
all rows is one row of it. Groups that exceed what a shard can hold are split
into pieces by a hash of the row's place. Pieces with at least
``1 / (shards * LARGE)`` of the whole in some dimension are placed first: by
pigeonhole at most ``3 * shards * LARGE`` of them exist, a proven bound, so
one list of them is packed at once. All others are packed in parallel, each
task with its own share of the capacity that the large ones left.

Slots are gapless per shard: blocks of at most ``SLOT_BLOCK`` rows of the
stored assignment are numbered on their own and shifted by the running count
of the blocks before.

Defined results: a null text has size 1 and the CRC of no bytes, like the
empty text, and is in its group. Repeated rows get a slot each. Null ids are
rows like others. An empty table gives an empty result. Only id and text are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import WORD_BYTES, stored

LARGE = 64
SLOT_BLOCK = 65_536
UNITS_PER_TASK = 100_000
DIMENSIONS = ["bytes", "tokens", "rows"]
#: bytes lead: the law that holds is near-equal bytes, the others are balanced beside it
WEIGHTS = np.array([4.0, 1.0, 1.0])


def place(demand: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard per demand (rows in the order of placement), by the highest dot
    product of demand and residual capacity among the shards whose bytes it
    fits; where it fits none, the one with most bytes left. ``residual`` is
    brought up to date."""
    out = np.empty(len(demand), np.int32)
    for i, d in enumerate(demand):
        score = residual @ (d * WEIGHTS)
        fits = residual[:, 0] >= d[0]
        score = np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]
        out[i] = k = int(score.argmax())
        residual[k] -= d
    return out


def vector_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, tokens, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD_BYTES)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("key")), "shard-rows")
    at = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    whole = np.array([max(total[c] or 0, 1) for c in DIMENSIONS], float)
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]

    # texts beyond one shard's capacity: at most 3 * n_shards of them
    share = F.greatest(*[F.col(c) / F.lit(w) for c, w in zip(DIMENSIONS, whole)])
    big = (rows.groupBy("key").agg(*sums).filter(share > 1.0 / n_shards)
           .select("key", F.ceil(share * (2 * n_shards)).cast("long").alias("parts")).toPandas())
    big = spark.createDataFrame([(k, int(p)) for k, p in zip(big["key"], big["parts"])], "key string, parts long")
    placed_at = rows.select("*", at.alias("at")).join(F.broadcast(big), "key", "left")
    rows_p = placed_at.withColumn("part", F.coalesce(F.pmod("at", "parts"), F.lit(0)).cast("int")).drop("at", "parts")

    units = stored(rows_p.groupBy("key", "part").agg(*sums).withColumn("share", share), "shard-units")
    limit = 1.0 / (n_shards * LARGE)
    large = units.filter(F.col("share") >= limit).toPandas().sort_values(["share", "key", "part"], ascending=[False, True, True])
    residual = np.full((n_shards, 3), 1.0 / n_shards)
    large["shard"] = place(large[DIMENSIONS].to_numpy(float) / whole, residual)
    residual = np.maximum(residual, 0)
    first = spark.createDataFrame(
        [(k, int(p), int(s)) for k, p, s in zip(large["key"], large["part"], large["shard"])], "key string, part int, shard int")
    capacity = residual / np.maximum(residual.sum(axis=0), 1e-12)

    def pack(batches):
        part = [b for b in batches if len(b)]
        if part:
            pdf = pd.concat(part).sort_values(["share", "key", "part"], ascending=[False, True, True])
            demand = pdf[DIMENSIONS].to_numpy(float) / whole
            pdf["shard"] = place(demand, capacity * demand.sum(axis=0))
            yield pdf[["key", "part", "shard"]]

    small = units.filter(F.col("share") < limit)
    n_tasks = max(1, -(-units.count() // UNITS_PER_TASK))
    rest = small.repartition(n_tasks, "key").mapInPandas(pack, "key string, part int, shard int")
    shards = stored(first.unionByName(rest), "shard-of")
    assigned = stored(rows_p.join(shards, ["key", "part"]).select("id", "size", "text_crc32", "tokens", "shard"), "shard-rows-of")

    block = [F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / SLOT_BLOCK).alias("block")]
    numbered = assigned.select("*", *block, F.col("_metadata.row_index").alias("row"))
    before = (assigned.select("shard", *block).groupBy("shard", "file", "block").count()
              .select("shard", "file", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("file", "block"))
                                                 - F.col("count")).alias("before")))
    own = Window.partitionBy("shard", "file", "block").orderBy("row")
    return (numbered.withColumn("own", F.row_number().over(own) - 1).join(before, ["shard", "file", "block"])
            .select("id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("own")).alias("slot")))
