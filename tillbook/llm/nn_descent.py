"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched
greedily.

Equal vectors are one node (its smallest id), so a vector that occurs very
often is one row of the graph; results are expanded to its members.

Building: nodes start with neighbours from random-hyperplane leaves. Then, in
``rounds`` rounds at most (fewer once under ``enough`` of the edges are new;
the search is exact about what the graph holds, recall is measured), every node brings its neighbours and reverse neighbours together
(joins: edges with the vectors of their ends, grouped by the node in between),
pairs of them that were not compared before are compared, each member emits its
``EMITTED`` nearest of them, and each node keeps its ``degree`` nearest. Members of a group are bounded (``degree`` out, at
most ``degree`` in), so a hub is not a large group. Vectors travel as bytes
with a scale while the graph is built; a search measures the original ones in
double precision.

Searching: all queries go at once. A query starts at its own node, if it is in
the table, and at a few pivots; each round its nearest nodes that were not
expanded are joined with the graph, their neighbours with the vectors, and the
``beam`` nearest stay, until no query has a node left to expand.

The graph holds every vector that takes part. Pivots (``pivots`` vectors) are
all that is broadcast.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither do those whose length is not the most common
one (ties: the longer). Null ids take no part; rows that repeat an id count
once (the smallest vector). With fewer candidates than asked for, all that
are found are returned; an empty table gives an empty result. Ties in distance
go to the smaller id. Only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import stored

LEAF = 96
EMITTED = 6


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part."""
    v = F.col("vec")
    ok = F.aggregate(v, F.lit(True), lambda acc, x: acc & F.coalesce((~F.isnan(x)) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(ok & some))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1)
    dim = sizes.select("size").first()
    return rows.filter(F.size("vec") == (dim[0] if dim else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def quantised(nodes: DataFrame) -> DataFrame:
    """(node, q, s): a vector as signed bytes and a scale."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.vstack([np.asarray(v, np.float64) for v in b.column("vec").to_pylist()])
                s = np.abs(x).max(axis=1) / 127
                q = np.rint(x / s[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s, pa.float64())], names=["node", "q", "s"])
    return nodes.select("node", "vec").mapInArrow(run, "node bigint, q binary, s double")


def _flat(column: pa.ListArray):
    """Offsets and the fields of a column of lists of structs."""
    offsets = column.offsets.to_numpy()
    values = column.values
    return offsets, {f.name: values.field(i) for i, f in enumerate(values.type)}


def _plain(fields: dict) -> np.ndarray:
    n = len(fields["q"])
    raw = b"".join(fields["q"].to_pylist())
    return np.frombuffer(raw, np.int8).reshape(n, -1).astype(np.float32) * fields["s"].to_numpy()[:, None].astype(np.float32)


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    d = sq[:, None] + sq[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    return np.maximum(d, 0)


def compare_members(groups: DataFrame, keep: int) -> DataFrame:
    """(node, id, d): for each member of a group its ``keep`` nearest members
    that are nearer than ``kth``, with at least one of the two new."""
    def run(batches):
        for b in batches:
            offsets, fields = _flat(b.column("members"))
            if not len(fields["id"]):
                continue
            x, ids = _plain(fields), fields["id"].to_numpy()
            new, kth = fields["is_new"].to_numpy(zero_copy_only=False), fields["kth"].to_numpy()
            left, right, far = [], [], []
            for lo, hi in zip(offsets[:-1], offsets[1:]):
                if hi - lo < 2 or not new[lo:hi].any():
                    continue
                d = _distances(x[lo:hi])
                own, fresh = ids[lo:hi], new[lo:hi]
                d[~(fresh[:, None] | fresh[None, :])] = np.inf
                d[own[:, None] == own[None, :]] = np.inf
                d[d >= kth[lo:hi, None]] = np.inf
                k = min(keep, hi - lo - 1)
                at = np.argpartition(d, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(d, at, axis=1)
                r, c = np.nonzero(np.isfinite(near))
                left.append(own[r])
                right.append(own[at[r, c]])
                far.append(near[r, c])
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64()),
                     pa.array(np.concatenate(far).astype(np.float64), pa.float64())], names=["node", "id", "d"])
    return groups.select("members").mapInArrow(run, "node bigint, id bigint, d double")


def leaves(nodes: DataFrame, bytes_of: DataFrame, count: int, dim: int, trees: int) -> DataFrame:
    """Groups of about ``LEAF`` nodes on the same sides of random
    hyperplanes through the mean; a larger leaf is dealt into parts."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / (LEAF / 2)))))
    mean = nodes.select(*[F.avg(F.col("vec")[i]).alias(f"m{i}") for i in range(dim)]).first()
    mean = np.array(mean, float)
    planes = np.random.default_rng(11).standard_normal((dim, trees * bits))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.vstack([np.asarray(v, np.float64) for v in b.column("vec").to_pylist()]) - mean
                side = (x @ planes > 0).reshape(len(x), trees, bits)
                code = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(code.tolist(), pa.list_(pa.int64()))], names=["node", "codes"])

    coded = nodes.select("node", "vec").mapInArrow(run, "node bigint, codes array<bigint>")
    rows = coded.select("node", F.posexplode("codes").alias("tree", "code"))
    sizes = rows.groupBy("tree", "code").count().withColumn("parts", F.ceil(F.col("count") / LEAF)).drop("count")
    dealt = (rows.join(sizes, ["tree", "code"])
             .withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts"))).drop("parts").join(bytes_of, "node"))
    member = F.struct(F.col("node").alias("id"), F.lit(True).alias("is_new"), F.lit(float("inf")).alias("kth"), "q", "s")
    return dealt.groupBy("tree", "code", "part").agg(F.collect_list(member).alias("members"))


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """(node, near): the nearest distinct ends per node, as a sorted array."""
    return (edges.repartition("node").groupBy("node", "id").agg(F.min("d").alias("d"), F.min("is_new").alias("is_new"))
            .groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "is_new"))), 1, degree).alias("near")))


def _few(edges: DataFrame, key: str, other: str, most: int) -> DataFrame:
    """At most ``most`` rows per key, by a hash; in two steps, so that the
    rows of a hub never meet in one window."""
    order = F.xxhash64(key, other)
    part = Window.partitionBy(key, F.pmod(F.xxhash64(other), F.lit(64))).orderBy(order)
    whole = Window.partitionBy(key).orderBy(order)
    return (edges.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= most)
            .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= most).drop("r"))


def neighbour_graph(nodes: DataFrame, degree: int = 24, rounds: int = 6, trees: int = 4, enough: float = 0.01) -> DataFrame:
    """(node, near array<struct<d, id, is_new>>) over (node, vec)."""
    first = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    count, dim = first[0], first[1] or 0
    q = stored(quantised(nodes), "ann-bytes")
    if count < 2:
        return q.select("node", F.array().cast("array<struct<d:double,id:bigint,is_new:boolean>>").alias("near"))
    start = compare_members(leaves(nodes, q, count, dim, trees), degree)
    graph = stored(_nearest(start.withColumn("is_new", F.lit(True)), degree), "ann-graph")
    for _ in range(rounds):
        edges = graph.select("node", F.explode("near").alias("e")).select("node", "e.*")
        back = _few(edges.select(F.col("id").alias("node"), F.col("node").alias("id"), "is_new"), "node", "id", degree)
        between = (edges.select("node", "id", "is_new").unionByName(back).withColumnRenamed("node", "center")
                   .groupBy("center", "id").agg(F.max("is_new").alias("is_new")))
        full = graph.select(F.col("node").alias("id"), F.when(F.size("near") >= degree, F.element_at("near", -1)["d"])
                            .otherwise(F.lit(float("inf"))).alias("kth"))
        of = q.withColumnRenamed("node", "id").join(full, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
        groups = between.join(of, "id").groupBy("center").agg(F.collect_list(F.struct("id", "is_new", "kth", "q", "s")).alias("members"))
        found = compare_members(groups, EMITTED).withColumn("is_new", F.lit(True))
        graph = stored(_nearest(found.unionByName(edges.select("node", "id", "d", F.lit(False).alias("is_new"))), degree), "ann-graph")
        fresh = graph.agg(F.sum(F.size(F.filter("near", lambda e: e["is_new"])))).first()[0] or 0
        if fresh <= enough * count * degree:
            break
    return graph


BEAM = "array<struct<d:double,id:bigint,done:boolean>>"


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = 256, expand: int = 32,
                  pivots: int = 64, degree: int = 24) -> DataFrame:
    """(query, beam): the nearest nodes found for each query (query, vec,
    own), sorted by distance; own is the query's node or null."""
    marks = nodes.orderBy(F.xxhash64("node")).limit(pivots).toPandas()
    mark_ids = marks["node"].to_numpy(np.int64)
    mark_vecs = np.vstack([np.asarray(v, float) for v in marks["vec"]]) if len(marks) else np.zeros((0, 0))
    edges = graph.select("node", F.explode("near").alias("e")).select("node", F.col("e.id").alias("id"))
    both = edges.unionByName(_few(edges.select(F.col("id").alias("node"), F.col("node").alias("id")), "node", "id", degree))
    links = stored(both.groupBy("node").agg(F.collect_set("id").alias("ids")), "ann-links")

    def begin(batches):
        for pdf in batches:
            rows = []
            for query, vec, own in zip(pdf["query"], pdf["vec"], pdf["own"]):
                d = np.sqrt(((mark_vecs - np.asarray(vec, float)) ** 2).sum(axis=1))
                order = np.argsort(d, kind="stable")[:expand]
                start = {int(mark_ids[k]): float(d[k]) for k in order}
                if own == own and own is not None:
                    start[int(own)] = 0.0
                rows.append((query, vec, [(d, i, False) for i, d in sorted(start.items(), key=lambda x: (x[1], x[0]))]))
            yield pd.DataFrame(rows, columns=["query", "vec", "beam"])

    state = stored(queries.mapInPandas(begin, f"query bigint, vec array<double>, beam {BEAM}"), "ann-beams")

    def step(batches):
        for pdf in batches:
            rows = []
            for query, vec, old, found in zip(pdf["query"], pdf["vec"], pdf["beam"], pdf["found"]):
                now = {int(e["id"]): (float(e["d"]), int(e["id"]), bool(e["done"])) for e in old}
                todo = sorted(e for e in now.values() if not e[2])[:expand]
                for d, i, _ in todo:
                    now[i] = (d, i, True)
                if found is not None and len(found):
                    ids = [int(e["id"]) for e in found]
                    x = np.vstack([np.asarray(e["vec"], float) for e in found])
                    far = np.sqrt(((x - np.asarray(vec, float)) ** 2).sum(axis=1))
                    for i, d in zip(ids, far.tolist()):
                        now.setdefault(i, (d, i, False))
                rows.append((query, vec, sorted(now.values())[:beam]))
            yield pd.DataFrame(rows, columns=["query", "vec", "beam"])

    while True:  # a query expands each node once at most, so this ends
        going = F.exists("beam", lambda e: ~e["done"])
        open_ = state.filter(going)
        todo = F.slice(F.filter("beam", lambda e: ~e["done"]), 1, expand)
        reach = (open_.select("query", F.explode(todo).alias("e"), F.transform("beam", lambda e: e["id"]).alias("seen"))
                 .select("query", F.col("e.id").alias("node"), "seen").join(links, "node")
                 .select("query", F.explode(F.array_except("ids", "seen")).alias("node")).distinct())
        found = (reach.join(nodes, "node").groupBy("query")
                 .agg(F.collect_list(F.struct(F.col("node").alias("id"), "vec")).alias("found")))
        after = open_.join(found, "query", "left").mapInPandas(step, f"query bigint, vec array<double>, beam {BEAM}")
        state = stored(after.unionByName(state.filter(~going)), "ann-beams")
        if state.filter(going).isEmpty():
            break
    return state.select("query", F.transform("beam", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"))).alias("beam"))


def nearest_neighbours(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding",
                       k: int = 10, degree: int = 24, beam: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where the condition
    ``is_query`` on column id holds, among all other rows."""
    rows = stored(valid_vectors(vectors, id_col, vector_col), "ann-rows")
    classes = stored(rows.groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("n")), "ann-classes")
    nodes = stored(classes.select("node", "vec"), "ann-nodes")
    graph = neighbour_graph(nodes, degree)
    of = rows.filter(is_query).join(classes, "vec").select(F.col("id").alias("query"), "vec", F.col("node").alias("own"))
    found = greedy_search(of, nodes, graph, beam=beam, degree=degree)
    # members of classes of several: the k + 1 smallest ids are enough for any query
    many = rows.join(classes.filter("n > 1").select("vec", "node"), "vec").select("node", "id")
    part = Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("node").orderBy("id")
    few = (many.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k + 1)
           .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1)
           .groupBy("node").agg(F.collect_list("id").alias("ids")))
    hits = (found.select("query", F.explode(F.slice("beam", 1, beam)).alias("e")).select("query", F.col("e.d").alias("score"), F.col("e.id").alias("node"))
            .join(few, "node", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("node"))).alias("vec_id"))
            .filter("vec_id <> query"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", "vec_id", "score"))
