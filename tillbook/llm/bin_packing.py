"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences by themselves. All others are dealt, by a hash, into blocks of about
``BLOCK`` pieces, so no task holds more than some blocks however large the
table is. Each block is evolved on several islands in parallel Spark tasks:

* a chromosome is an assignment of the block's pieces to bins; the first of an
  island's population is best-fit decreasing, others best-fit in shuffled order;
* crossover injects whole well-filled bins of one parent into another, drops
  the bins that hold duplicates of injected pieces, and puts the displaced
  pieces back by best fit, largest first;
* fitness is the mean squared fill of the bins;
* between rounds each island's elite migrates to the next island of its block.

The pieces of bins that stay poorly filled are dealt anew into blocks and
evolved once more, so what is left over by many blocks shares bins.

Defined results: a null text counts as the empty one: one piece with the end
id alone. Repeated rows (and null ids) are documents of their own. An empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import stored

BLOCK = 4096
END_ID = 0


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + size]`` one after the other."""
    done = np.cumsum(size)
    return flat[np.repeat(start - (done - size), size) + np.arange(done[-1] if len(done) else 0)]


# What the vocabulary does before its merges. Below U+0180 composing changes nothing and each letter has one lower case
# (but for U+0130, left out), so words of these signs alone are lowered and cut here by the same pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_SIGNS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130]
_LETTERS, _DIGITS = (re.escape("".join(c for c in _SIGNS if unicodedata.category(c)[0] == kind)) for kind in "LN")
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\n{_LETTERS}{_DIGITS}]+|\\n")
#: The byte-level alphabet: printable bytes stand for themselves, others from U+0100 on. The line feed between parts stays.
BYTE_SIGNS = np.arange(256, dtype="<u4")
_UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_SIGNS[_UNPRINTED] = 0x100 + np.arange(len(_UNPRINTED))
BYTE_SIGNS[0x0A] = 0x0A


class WordCodec:
    """Ids of texts by the ``tokenizers`` library. The vocabulary drops white
    space and never joins across it, so each run between ASCII white space is
    encoded once: it gets a number, its ids lie in one array, and texts are
    gathered from that. New words of plain Latin signs are cut into their parts
    here, and the library's merges run on the distinct parts alone; all others
    go through the library whole. The cache starts anew beyond ``cache_size``
    words. The library's defaults hold: a special token's name in a text is
    that token."""

    def __init__(self, path: str, cache_size: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_size = cache_size
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        suffix = form["model"].get("end_of_word_suffix")
        self.merges = None
        if (form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == PRE_TOKENIZER and suffix
                and all("<|" in t["content"] for t in form["added_tokens"])):
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            vocab = form["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a part
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._clear()

    @classmethod
    def of_process(cls, path: str) -> WordCodec:
        """One codec for all tasks that a Python worker runs."""
        codecs = sys.__dict__.setdefault("_tillbook_word_codecs", {})
        if path not in codecs:
            codecs[path] = cls(path)
        return codecs[path]

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)  # where in flat the ids of a word lie
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _put(self, numbers: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that ``PLAIN`` matches."""
        parts = _Numbers()
        parts["\n"] = 0
        codes = np.array([*map(parts.__getitem__, PARTS.findall("\n".join(words).lower())), 0])
        raw = np.frombuffer("\n".join(parts.new).encode(), np.uint8)
        spelt = BYTE_SIGNS[raw].tobytes().decode("utf-32-le").split("\n")
        found = self.merges.encode_batch_fast(["\n".join(spelt[at:at + 1024]) for at in range(0, len(parts.new), 1024)],
                                              add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])
        stop = np.concatenate([[0], np.flatnonzero(self.last[flat]) + 1])  # part 0, the line feed, has no ids
        if len(stop) != len(parts) or stop[-1] != len(flat):
            raise ValueError("the vocabulary does not mark the end of each part")
        start, size = np.concatenate([[0], stop[:-1]])[codes], np.diff(stop, prepend=0)[codes]
        until = np.concatenate([[0], np.cumsum(size)])[np.flatnonzero(codes == 0)]
        return np.diff(until, prepend=0), gathered(flat, start, size)

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        first = len(self.numbers) - len(new)
        while len(self.numbers) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        plain = [self.merges is not None and PLAIN.fullmatch(w) is not None and "<|" not in w for w in new]
        for is_plain in (True, False):
            at = [k for k, p in enumerate(plain) if p == is_plain]
            words = [new[k] for k in at]
            if not words:
                continue
            if is_plain:
                sizes, ids = self._plain_ids(words)
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
            self._put([first + k for k in at], sizes, ids)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text its ids and the end id, as unsigned 32-bit integers."""
        if len(self.numbers) > self.cache_size:
            self._clear()
        texts = pc.fill_null(texts, "")
        # the tokenizer lowers after composing, so letters before combining marks stay as they are here
        # (U+0300 to U+036F), as do the names of special tokens
        as_is = pc.match_substring_regex(texts, "[\u0300-\u036f]|<\\|")
        lists = pc.ascii_split_whitespace(pc.if_else(as_is, texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        self._learn()
        at = number[words.indices.to_numpy()]
        size = self.size[at]
        ids = gathered(self.flat, self.start[at], size)
        until = np.concatenate([[0], np.cumsum(size)])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        ids = np.insert(ids, until, END_ID)
        cuts = (until + np.arange(1, len(until) + 1)).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *cuts], cuts)]


def chunks(texts: pa.Array, most_bytes: int = 1 << 22):
    """Slices of the column of at most ``most_bytes`` of text, or of one text."""
    until = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(until[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(until, before + most_bytes, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32: every document cut into pieces."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        codec = WordCodec.of_process(vocabulary)
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            coded = itertools.chain.from_iterable(map(codec.ids, chunks(b.column("text"))))
            for doc_id, tokens in zip(b.column("id").to_pylist(), coded):
                for k, at in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[at:at + capacity]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_id), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, f"id {id_type.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Best fit: bins by what they have left, the fullest that fits first.
    The capacities that occur are bits of one integer."""

    def __init__(self, capacity: int):
        self.capacity, self.left = capacity, 0
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def add(self, bin_id: int, left: int) -> None:
        self.by_left[left].append(bin_id)
        self.left |= 1 << left
        self.count = max(self.count, bin_id + 1)

    def take(self, size: int) -> int:
        """A bin for ``size``: an open one, else a new one."""
        fits = self.left >> size
        if not fits:
            bin_id = self.count
            self.add(bin_id, self.capacity - size)
            return bin_id
        left = size + (fits & -fits).bit_length() - 1
        own = self.by_left[left]
        bin_id = own.pop()
        if not own:
            self.left &= ~(1 << left)
        self.add(bin_id, left - size)
        return bin_id


def best_fit(sizes: list[int], order, capacity: int, genes: np.ndarray | None = None) -> np.ndarray:
    """Assignment of pieces to bins. ``genes``: bins already fixed (-1: not)."""
    n = len(sizes)
    out = np.full(n, -1, np.int32) if genes is None else genes.copy()
    bins = Bins(capacity)
    if genes is not None:
        fixed = genes >= 0
        if fixed.any():
            fill = np.bincount(genes[fixed], weights=np.asarray(sizes)[fixed]).astype(np.int64)
            for b, f in enumerate(fill.tolist()):
                bins.add(b, capacity - f)
    for i in order:
        out[i] = bins.take(sizes[i])
    return out


def fitness(genes: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    fill = np.bincount(genes, weights=sizes) / capacity
    return float((fill ** 2).mean())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Well-filled bins of ``b`` go whole into ``a``; see the module."""
    fill_b = np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.choice(good, max(1, len(good) // 4), replace=False)] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    stays = ~broken[a]
    child = np.full(len(a), -1, np.int64)
    child[stays] = a[stays]
    child[injected] = b[injected] + len(broken)
    child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)[1]
    displaced = np.flatnonzero(child < 0)
    order = displaced[np.argsort(-sizes[displaced], kind="stable")]
    return best_fit(sizes.tolist(), order.tolist(), capacity, child.astype(np.int32))


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], generations: int, rng,
           members: int) -> list[np.ndarray]:
    """One island for one round; the best chromosome comes first. Stops when
    the number of bins reaches the lower bound."""
    as_list = sizes.tolist()
    if not population:
        order = np.argsort(-sizes, kind="stable")
        population = [best_fit(as_list, order.tolist(), capacity)]
    least = -(-int(sizes.sum()) // capacity)
    while len(population) < members and population[0].max() + 1 > least:
        noisy = np.argsort(-sizes * rng.uniform(0.8, 1.2, len(sizes)), kind="stable")
        population.append(best_fit(as_list, noisy.tolist(), capacity))
    scored = sorted(((fitness(g, sizes, capacity), k, g) for k, g in enumerate(population)), key=lambda x: (-x[0], x[1]))
    tick = len(scored)
    for _ in range(generations):
        if scored[0][2].max() + 1 <= least or len(scored) < 2:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False))
        child = crossover(scored[j][2], scored[i][2], sizes, capacity, rng)
        tick += 1
        scored = sorted([*scored, (fitness(child, sizes, capacity), tick, child)], key=lambda x: (-x[0], x[1]))[:members]
    return [g for _, _, g in scored]


def _evolve_blocks(states: DataFrame, capacity: int, generations: int, members: int, turn: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for block, island, sizes, population in zip(pdf["block"], pdf["island"], pdf["sizes"], pdf["population"]):
                sizes = np.asarray(sizes, np.int64)
                rng = np.random.default_rng([turn, int(block), int(island)])
                rows.append((block, island, sizes, [g.tolist() for g in evolve(
                    sizes, capacity, [np.asarray(g, np.int32) for g in population], generations, rng, members)]))
            yield pd.DataFrame(rows, columns=["block", "island", "sizes", "population"])

    return states.mapInPandas(run, "block bigint, island int, sizes array<bigint>, population array<array<int>>")


def genetic_packing(pieces: DataFrame, capacity: int, islands: int = 2, rounds: int = 2, generations: int = 8,
                    members: int = 4, block: int = BLOCK) -> DataFrame:
    """(uid, bin_block, bin) for pieces with columns uid and length (below
    capacity). uid is unique."""
    n_blocks = max(1, -(-pieces.count() // block))
    blocks = stored(pieces.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block"))
                    .agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items")), "ga-blocks")
    state = (blocks.select("block", F.col("items.length").alias("sizes"))
             .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
             .select("block", "island", "sizes", F.array().cast("array<array<int>>").alias("population")))
    # few rows, much work each: one task per some blocks, not per size of file
    state = state.repartition(min(n_blocks * islands, 4096), "block", "island")
    for turn in range(rounds):
        if turn:
            elites = (state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("elite")))
            state = (state.join(elites, ["block", "island"])
                     .select("block", "island", "sizes", F.concat(F.array("elite"), "population").alias("population"))
                     .repartition(min(n_blocks * islands, 4096), "block", "island"))
        state = stored(_evolve_blocks(state, capacity, generations, members, turn), "ga-islands")
    size = F.size(F.array_distinct(F.col("population")[0]))
    best = state.groupBy("block").agg(F.min_by(F.col("population")[0], F.struct(size, "island")).alias("genes"))
    return (blocks.join(best, "block")
            .select("block", F.posexplode("items").alias("at", "item"), "genes")
            .select("item.uid", "item.length", F.col("block").alias("bin_block"), F.element_at("genes", F.col("at") + 1).alias("bin")))


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id",
                     text_col: str = "text", poor: float = 0.97) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id,
    offset. ``poor``: bins filled less than this are packed once more."""
    pieces = stored(token_pieces(docs, vocabulary, capacity, id_col, text_col)
                    .withColumn("uid", F.monotonically_increasing_id()), "pieces")
    open_ = pieces.filter(F.col("length") < capacity).select("uid", "length")
    packed = stored(genetic_packing(open_, capacity), "packed")
    fill = packed.groupBy("bin_block", "bin").agg(F.sum("length").alias("fill"))
    marked = packed.join(fill, ["bin_block", "bin"])
    again = genetic_packing(stored(marked.filter(F.col("fill") < poor * capacity).select("uid", "length"), "poor"),
                            capacity, islands=2, rounds=1)
    bins = (marked.filter(F.col("fill") >= poor * capacity).select("uid", "length", F.lit(0).alias("pass"), "bin_block", "bin")
            .unionByName(again.select("uid", "length", F.lit(1).alias("pass"), "bin_block", "bin")))
    # a bin holds at most ``capacity`` pieces (each has a token at least)
    from pyspark.sql import Window
    own = Window.partitionBy("pass", "bin_block", "bin").orderBy(F.desc("length"), "uid")
    placed = (bins.withColumn("offset", F.sum("length").over(own) - F.col("length"))
              .withColumn("sequence_id", (F.col("bin_block") * 2 + F.col("pass")) * 65536 + F.col("bin"))
              .select("uid", "offset", "sequence_id"))
    return (pieces.join(placed, "uid", "left")
            .select("id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("sequence_id", -F.col("uid") - 1).alias("sequence_id"),
                    F.coalesce("offset", F.lit(0)).cast("long").alias("offset")))
