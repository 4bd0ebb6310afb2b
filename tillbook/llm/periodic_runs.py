"""Periodic runs of words: maximal stretches that repeat with some period.

Method (Baier grouping). A suffix sorter's first phase groups suffixes by their
longest Lyndon prefix: groups are taken from the greatest down, and every
suffix that lies directly before members of the group grows by them and moves
to a new group just above its old one. When a group's turn comes, the length of
its shared prefix is final, so the Lyndon array falls out without sorting the
suffixes to the end. This is done under an order of the words and under its
reverse; every run has a Lyndon root in one of the two arrays. Roots are
extended to both sides through longest common extensions (ranks of blocks of
2^k words, exact) into runs.

Before grouping, words that no wanted run can hold are cut off: a run of
exponent e holds each of its words at least floor(e) times, so a word that is
rarer than that in its stretch ends the stretch, and what is left is looked at
again until nothing more falls off. This drops no run and ends none early: a
word that extends a run occurs in the run often enough.

A text is one value and is handled by one task; texts are split over tasks by
Spark, in blocks of at most ``CHUNK`` words (or one text) at a time.

Defined results: null, empty and blank texts have no words and no runs, four
nulls, the hash of the empty string twice. Equal rows give equal rows. Other
columns are not read. A null id is never planted.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import map_arrow

CHUNK = 400_000


def lyndon_array(x: list[int], n_symbols: int) -> list[int]:
    """Length of the longest Lyndon word that starts at every place of ``x``
    (numbers below ``n_symbols``)."""
    n = len(x)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours among the places not yet grouped
    group = list(x)
    members: list[list[int]] = [[] for _ in range(n_symbols)]
    for i, s in enumerate(x):
        members[s].append(i)
    size = [len(m) for m in members]
    lower, upper = list(range(-1, n_symbols - 1)), list(range(1, n_symbols + 1))
    upper[-1] = -1
    length = [0] * n
    g = n_symbols - 1
    while g >= 0:
        grown: dict[int, int] = {}  # place -> members of this group that follow it directly
        for i in members[g]:
            if group[i] != g:  # has moved up since
                continue
            j, k = before[i], after[i]
            length[i] = k - i
            if k < n:
                before[k] = j
            if j >= 0:
                after[j] = k
                grown[j] = grown.get(j, 0) + 1
        if grown:
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in grown.items():
                h = group[j]
                if (h, times) in moves:
                    moves[h, times].append(j)
                else:
                    moves[h, times] = [j]
            # more members after it: greater; inserted first, pushed up by the rest
            for h, times in sorted(moves, key=lambda m: -m[1]) if len(moves) > 1 else moves:
                places = moves[h, times]
                if size[h] == len(places):  # the whole group grows alike
                    continue
                size[h] -= len(places)
                new, above = len(members), upper[h]
                members.append(places)
                size.append(len(places))
                lower.append(h)
                upper.append(above)
                upper[h] = new
                if above >= 0:
                    lower[above] = new
                for j in places:
                    group[j] = new
        g = lower[g]
    return length


class Extensions:
    """Longest common extensions in one sequence, by ranks of its blocks."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank]
        step = 1
        while len(rank) > step and int(rank.max()) + 1 < len(rank):
            key = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            self.levels.append(rank)
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of x[i:] and x[j:], i < j."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            inside = b < len(rank)
            same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
            a[same] += 1 << k
            b[same] += 1 << k
        return a - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of x[:i] and x[:j], i < j."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            inside = (a >= step) & (b - step < len(rank))
            same = inside & (rank[np.where(inside, a - step, 0)] == rank[np.where(inside, b - step, 0)])
            a[same] -= step
            b[same] -= step
        return i - a


def candidate_places(words: np.ndarray, places: np.ndarray, exponent: int, shortest: int) -> np.ndarray:
    """Indices of the words that a run may hold. ``places`` grow by one inside
    a text and by more between texts."""
    at = np.arange(len(words))
    while len(at):
        piece = np.cumsum(np.diff(places[at], prepend=places[at[0]] - 1) != 1)
        _, of, times = np.unique(piece * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        keep = (times[of] >= exponent) & (np.bincount(piece)[piece] >= shortest)
        if keep.all():
            break
        at = at[keep]
    return at


def find_runs(words: np.ndarray, places: np.ndarray, exponent: int = 4, shortest: int = 6) -> np.ndarray:
    """All runs of exponent >= ``exponent`` (2 at least) and ``shortest`` words
    at least, as rows (place of the first word, length, period), sorted.
    ``words``: numbers; ``places`` as in ``candidate_places``."""
    at = candidate_places(words, places, exponent, shortest)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(places[at]) != 1) + 1
    firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    starts, periods = [], []
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        symbols, x = np.unique(words[at[a:b]], return_inverse=True)
        n = len(symbols)
        for ranks in (x, n - 1 - x):
            period = np.array(lyndon_array(ranks.tolist(), n), np.int64)
            i = np.arange(b - a)
            fits = i + period < b - a
            i, period = i[fits], period[fits]
            fits = x[i] == x[i + period]
            starts.append(i[fits] + a)
            periods.append(period[fits])
    i, p = np.concatenate(starts), np.concatenate(periods)
    # one sequence of all stretches, a symbol of its own between any two
    breaks = int(words.max()) + 1 + np.arange(len(firsts))
    shift = np.repeat(np.arange(len(firsts)), lasts - firsts)
    joined = np.empty(len(at) + len(firsts), np.int64)
    joined[np.arange(len(at)) + shift] = words[at]
    joined[lasts + np.arange(len(firsts))] = breaks
    common = Extensions(joined)
    left = i + shift[i]
    back, ahead = common.backward(left, left + p), common.forward(left, left + p)
    total = back + p + ahead
    good = total >= np.maximum(shortest, exponent * p)
    return np.unique(np.stack([places[at[i[good]]] - back[good], total[good], p[good]], axis=1), axis=0)


def planted(n: int, doc_id) -> np.ndarray | None:
    """Word numbers of a text of n words whose id asks for a planted
    repetition (every tenth by CRC-32 of the id); None where it asks for none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def text_blocks(ids, texts, plant: bool):
    """Lists of word lists, of CHUNK words or one text."""
    block, size = [], 0
    for i, t in zip(ids, texts):
        words = (t.as_py() or "").encode().split()
        order = planted(len(words), i.as_py()) if plant else None
        if order is not None:
            words = [words[k] for k in order.tolist()]
        block.append(words)
        size += len(words)
        if size >= CHUNK:
            yield block
            block, size = [], 0
    if block:
        yield block


def block_runs(block: list[list[bytes]], exponent: int, shortest: int) -> list[np.ndarray]:
    """Runs of each text of a block, places counted from its first word."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in block], np.int64)
    words = np.fromiter((number.setdefault(w, len(number)) for ws in block for w in ws), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes + 1) - sizes - 1
    runs = find_runs(words, np.arange(len(words)) + np.repeat(np.arange(len(block)), sizes), exponent, shortest)
    cuts = np.searchsorted(runs[:, 0], np.append(first, first[-1] + sizes[-1] + 1))
    return [runs[cuts[k]:cuts[k + 1]] - [first[k], 0, 0] for k in range(len(block))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def strongest(runs: np.ndarray) -> tuple:
    """(start, length, period, exponent in thousandths) of the run with the
    greatest exact exponent; ties to the smallest start, then period."""
    best = None
    for s, n, p in runs.tolist():
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6,
                  plant: bool = False, with_runs: bool = False) -> DataFrame:
    """Runs of every text. One row per input row: id, n_words, n_runs, the
    strongest run (start, length, period, exponent_milli), runs_sha256 and
    collapsed_sha256; with ``with_runs`` also ``runs`` (array of start, length,
    period) and the collapsed text. ``plant`` first repeats a part of every
    tenth text (see ``planted``)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", runs array<array<bigint>>, collapsed string" if with_runs else ""
    schema = pa.schema([("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                        ("collapsed_sha256", pa.string())])
    if with_runs:
        schema = schema.append(pa.field("runs", pa.list_(pa.list_(pa.int64())))).append(pa.field("collapsed", pa.string()))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for block in text_blocks(b.column("id"), b.column("text"), plant):
            for words, runs in zip(block, block_runs(block, exponent, shortest)):
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist()).encode()
                kept = b" ".join(collapse(words, runs))
                row = (len(words), len(runs), *strongest(runs), hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())
                rows.append((*row, runs.tolist(), kept.decode()) if with_runs else row)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", *schema.names])

    return map_arrow(src, batch, f"id {src.schema['id'].dataType.simpleString()}, n_words bigint, n_runs bigint, start bigint, "
                                 "length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string" + more)
