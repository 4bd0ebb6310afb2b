"""MinHash near-duplicate detection with tensored banding.

A document's set is its distinct 5-word shingles (64-bit hashes; words in
lower-case A-Z). Documents with equal sets are one class from the start, so
copies are neither hashed into tables nor compared again.

Tables: two collections of ``side`` sub-hashes each, a sub-hash being
``rows`` minhashes. Every pair of one sub-hash of either collection is the key
of a table: ``side ** 2`` tables of ``2 * rows`` minhashes each, from only
``2 * side * rows`` minhashes. A pair at Jaccard similarity s is missed with
probability of at most ``2 * (1 - s ** rows) ** side`` (2.2e-5 at 0.85 with
rows 3 and side 12). A key can only be shared if both its sub-hashes are, so
keys are formed from shared sub-hashes alone.

Candidates are verified on full sets. Within a bucket no all-pairs list is
made: rounds link the bucket's members to one leader, components are joined,
and only buckets that still hold several components go on, with another
leader. What is left after the leader rounds goes through an exact prefix and
positional filter on full sets, so no link between components is lost, and
members of a large family that differ too much from each other never pair up.

All steps are joins and aggregates on stored narrow tables; components are
found by min-label contraction in Spark.

Defined results: a null text, or one without words, has the empty set, links
with nothing and is kept (component_id its own id). Rows with a null id take
no part: component_id null, kept true (``drop_near_duplicates`` numbers the
rows, so there they do). Different texts of one id are one node of the graph
here. Rows that repeat an id and text share
their component and verdict. An empty table gives an empty result. Only id and
text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import document_key, stored

K = 5
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes; word hashes are kept
    in a bounded cache."""

    def __init__(self, cache_size: int = 400_000):
        self.cache: dict[bytes, int] = {}
        self.cache_size = cache_size

    def shingles(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < K:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], U64)
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        get, digest = self.cache.get, xxhash.xxh3_64_intdigest
        found = list(map(get, words))
        if None in found:
            for w, h in zip(words, found):
                if h is None:
                    self.cache[w] = digest(w)
            found = list(map(get, words))
        w = np.array(found, U64)
        n = len(w) - K + 1
        h = np.zeros(n, U64)
        for i in range(K):
            h = _mix((h + U64(0x9E3779B97F4A7C15)) ^ w[i:i + n])
        return np.unique(h)


def sub_hashes(shingles: np.ndarray, rows: int, side: int) -> np.ndarray:
    """``2 * side`` sub-hashes, each of ``rows`` minhashes."""
    count = 2 * side * rows
    rng = np.random.default_rng(20_250_101)
    a = rng.integers(0, 2**63, count, dtype=np.uint64)[:, None] * U64(2) + U64(1)
    b = rng.integers(0, 2**63, count, dtype=np.uint64)[:, None]
    least = np.full(count, ~U64(0))
    for i in range(0, len(shingles), 4096):
        x = (shingles[i:i + 4096][None, :] ^ b) * a
        least = np.minimum(least, (x ^ (x >> U64(32))).min(axis=1))
    least = least.reshape(2 * side, rows)
    h = np.zeros(2 * side, U64)
    for r in range(rows):
        h = _mix((h + U64(0x9E3779B97F4A7C15)) ^ least[:, r])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, rows: int, side: int) -> DataFrame:
    """k_id, k_text, n_shingles, set_hi and set_lo (a 128-bit hash of the
    set), sig (the sub-hashes; empty for empty sets)."""
    src = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    id_type = src.schema["k_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        shingler = Shingler()
        for b in batches:
            n, hi, lo, sig = [], [], [], []
            for value in b.column("text"):
                s = shingler.shingles(value.as_py())
                both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                hi.append(int(both[0]))
                lo.append(int(both[1]))
                sig.append(sub_hashes(s, rows, side) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("k_id"), b.column("k_text"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                names=["k_id", "k_text", "n_shingles", "set_hi", "set_lo", "sig"])

    return src.mapInArrow(run, f"k_id {id_type}, k_text bigint, n_shingles bigint, set_hi bigint, set_lo bigint, sig array<bigint>")


def full_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) of the class representatives in ``reps``."""
    src = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(reps, "rep", "left_semi")
    id_type = src.schema["rep"].dataType.simpleString()

    def run(batches):
        shingler = Shingler()
        for b in batches:
            sets = [shingler.shingles(v.as_py()).view(np.int64) for v in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])

    return src.mapInArrow(run, f"rep {id_type}, set array<bigint>")


def table_keys(reps: DataFrame, side: int) -> DataFrame:
    """(key, rep, n) for the tensored tables, only where a key is shared."""
    subs = reps.select("rep", "n", F.posexplode("sig").alias("pos", "h"))
    shared = subs.join(subs.groupBy("pos", "h").count().filter("count > 1").drop("count"), ["pos", "h"], "left_semi")
    sides = shared.groupBy("rep", "n").agg(
        F.collect_list(F.when(F.col("pos") < side, F.struct("pos", "h"))).alias("left"),
        F.collect_list(F.when(F.col("pos") >= side, F.struct("pos", "h"))).alias("right"))
    keys = (sides.withColumn("l", F.explode("left")).withColumn("r", F.explode("right"))
            .select(F.xxhash64("l.pos", "l.h", "r.pos", "r.h").alias("key"), "rep", "n"))
    return keys


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b): comp is the smallest
    node reachable. Each round hooks every node to its smallest neighbour,
    follows two steps, and contracts the edges."""
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        parent = stored(parent, "parents")
        labels = (parent.select("node", F.col("p").alias("comp")) if labels is None else stored(
            labels.join(parent.select(F.col("node").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels"))
        edges = stored(edges.join(parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
                       .join(parent.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
                       .filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    rows: int = 3, side: int = 12, leader_rounds: int = 2) -> DataFrame:
    """One row per input row: k_id, k_text, n_shingles, component_id, kept.
    Documents with 100 * intersection >= percent * union are linked."""
    sigs = stored(signatures(docs, id_col, text_col, rows, side), "signatures")
    classes = stored(sigs.filter("n_shingles > 0 and k_id is not null").groupBy("set_hi", "set_lo", "n_shingles")
                     .agg(F.min("k_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keys = stored(table_keys(classes.select("rep", F.col("n_shingles").alias("n"), "sig"), side), "keys")
    near = _linked(docs, keys, id_col, text_col, percent, leader_rounds)
    found = sigs.select("k_id", "k_text", "n_shingles", "set_hi", "set_lo")
    reps = classes.select("set_hi", "set_lo", F.col("n_shingles").alias("n"), "rep")
    cond = ((found["set_hi"] == reps["set_hi"]) & (found["set_lo"] == reps["set_lo"]) & (found["n_shingles"] == reps["n"])
            & found["k_id"].isNotNull())
    out = found.join(reps, cond, "left").select("k_id", "k_text", "n_shingles", "rep")
    if near is not None:
        out = out.join(near.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    else:
        out = out.withColumn("comp", F.col("rep"))
    comp = F.coalesce("comp", "rep", "k_id")
    return out.select("k_id", "k_text", "n_shingles", comp.alias("component_id"),
                      F.coalesce(comp == F.col("k_id"), F.lit(True)).alias("kept"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on full sets."""
    both = (pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a"))
    same = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * same >= percent * (F.size("set_a") + F.size("set_b") - same)).select("a", "b").distinct()


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``left`` (rep, n, comp) in different components
    that can be similar enough, by an exact prefix and positional filter.

    Every set is put in one order, rarest shingle first. A pair that reaches
    the similarity shares a shingle within both prefixes, and at the first
    shared one the rest of both sets must still suffice. Shingles common to a
    large family come late, so members that differ too much never pair up."""
    items = left.join(sets, "rep").select("rep", "n", "comp", F.explode("set").alias("s"))
    often = items.groupBy("s").agg(F.count("*").alias("f"))
    ordered = (items.join(often, "s").groupBy("rep", "n", "comp")
               .agg(F.sort_array(F.collect_set(F.struct("f", "s"))).alias("order")))
    probe = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")
    # the smaller set of a pair needs a shorter prefix only: what it must share
    # with a set of its own size or larger
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)) + 1
    prefix = stored(ordered.select("rep", "n", "comp", F.posexplode(F.slice("order", 1, probe)).alias("pos", "e"))
                    .filter("e.f > 1").select("rep", "n", "comp", "pos", F.col("e.s").alias("s")), "prefix")
    other = prefix.filter(F.col("pos") < index).select("s", *[F.col(c).alias(f"o_{c}") for c in ("rep", "n", "comp", "pos")])
    smaller = (F.col("o_n") < F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_rep") < F.col("rep")))
    rest = F.least(F.col("n") - F.col("pos"), F.col("o_n") - F.col("o_pos"))  # shared at most, from here on
    enough = rest * (100 + percent) >= percent * (F.col("n") + F.col("o_n"))
    return (prefix.join(other, "s").filter(smaller & (F.col("comp") != F.col("o_comp")) & enough)
            .select(*_pair(F.col("rep"), F.col("o_rep"))))


def _linked(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, percent: int, leader_rounds: int) -> DataFrame | None:
    """(node, comp) of all linked representatives; None where none is."""
    sets = None
    links = tested = labels = None
    for turn in range(leader_rounds + 1):
        rows = keys.withColumn("comp", F.col("rep")) if labels is None else (
            keys.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        fits = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
        # another member leads the bucket each round
        rank = F.xxhash64("key", "rep", F.lit(turn)) if turn else F.col("rep")
        lead = (rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.min_by(F.struct(F.col("rep").alias("o_rep"), F.col("n").alias("o_n"), F.col("comp").alias("o_comp")), rank).alias("o"))
                .filter("lo <> hi").select("key", "o.*"))
        if turn < leader_rounds:
            pairs = rows.join(lead, "key").filter((F.col("comp") != F.col("o_comp")) & fits).select(*_pair(F.col("rep"), F.col("o_rep")))
        else:
            left = stored(rows.join(lead.select("key"), "key", "left_semi").select("rep", "n", "comp").distinct(), "left")
            if sets is None:  # no two members were ever similar enough in size
                break
            pairs = _prefix_pairs(left, sets, percent)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            if turn < leader_rounds:
                continue
            break
        if sets is None:
            everyone = keys.join(keys.groupBy("key").count().filter("count > 1").drop("count"), "key", "left_semi")
            sets = stored(full_sets(docs, everyone.select("rep").distinct(), id_col, text_col), "sets")
        new = stored(_verified(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
    return labels


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                         rows: int = 3, side: int = 16) -> DataFrame:
    """One document of each group of near duplicates: the one with the
    smallest id (rows without an id only where no other is), all columns
    unchanged. Every row is a document of its own here, whatever its id, so
    rows that share an id, or have none, are linked by their texts like others.
    Documents without words are linked with nothing; of those that repeat an id
    and text one stays. Documents of a similarity of ``percent`` or more are
    linked; a pair at 80 is missed with a probability of at most 2.1e-5 (rows
    3, side 16)."""
    node = "__node"
    while node in docs.columns:
        node += "_"
    numbered = stored(docs.withColumn(node, F.monotonically_increasing_id()), "numbered")
    near = near_duplicates(numbered, node, text_col, percent, rows, side).select(F.col("k_id").alias("node"), "component_id", "n_shingles")
    k_id, k_text = document_key(id_col, text_col)
    of = near.join(numbered.select(F.col(node).alias("node"), k_id, k_text), "node")
    linked = F.col("n_shingles") > 0
    first = F.min(F.struct(F.col("k_id").isNull(), "k_id", "node"))["node"].alias(node)
    kept = of.groupBy(F.when(linked, F.col("component_id")), F.when(~linked, F.col("k_id")), F.when(~linked, F.col("k_text"))).agg(first)
    return numbered.join(kept.select(node), node, "left_semi").drop(node)
