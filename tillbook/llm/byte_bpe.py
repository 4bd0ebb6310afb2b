"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without regular expressions. Every code point has a
class (letter, number, space, other white space, other, and apostrophes that
may open a contraction). A small automaton reads the classes; each class is a
transition function on its states, and composing functions is associative, so
the state before every code point comes from a blocked prefix scan over
function numbers in numpy, for all texts of a batch at once: rows of code
points are composed column by column, the row totals are scanned the same way,
and a second sweep applies them. A code point starts a slice as a function of
the state before it and its class. Slices are merged by rank (heap and linked
list, so a very long slice costs n log n) and cached up to a bounded number
of entries. Slice offsets are kept, so decoding gives bytes and their place.

Defined results: a null text is encoded as the empty one, no ids. Invalid
ranks do not occur: every byte has a rank of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import map_arrow

# classes of code points
LETTER, NUMBER, SPACE, BLANK, OTHER, LAST_BLANK, LAST_SPACE, QUOTE_ONE, QUOTE_TWO, BREAK = range(10)
# automaton states: what the code point before was
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_TAKE_TWO, S_TAKE_ONE, S_CONTRACTED = range(9)
N_STATES, N_CLASSES = 9, 10

# fixed values: the White_Space property of Unicode
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
CONTRACT_ONE = "stmd"
CONTRACT_TWO = ("re", "ve", "ll")


def class_table() -> np.ndarray:
    """Class of every code point, by its general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)  # no letters or numbers lie beyond the third plane
    table[:0x40000] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)), np.uint8)
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether the code point starts a slice."""
    if kind == BREAK:  # first code point of a text is read after one of these
        return S_START, True
    if state == S_TAKE_TWO:
        return S_TAKE_ONE, False
    if state == S_TAKE_ONE:
        return S_CONTRACTED, False
    if kind in (SPACE, BLANK):
        return S_BLANK, state != S_BLANK
    if kind == LAST_BLANK:  # the last of a run before a word stands alone
        return S_START, True
    if kind == LAST_SPACE:  # a space directly before a word joins it
        return S_SPACE, True
    joins = state == S_SPACE
    if kind in (QUOTE_ONE, QUOTE_TWO) and state not in (S_SPACE, S_OTHER):
        return (S_TAKE_ONE if kind == QUOTE_ONE else S_TAKE_TWO), True
    own = {LETTER: S_LETTER, NUMBER: S_NUMBER}.get(kind, S_OTHER)
    return own, not joins and state != own


def scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's transition function, the composition table over
    all reachable functions, each function's map of states, and the start
    flags by (state, class)."""
    base = [tuple(_step(s, k)[0] for s in range(N_STATES)) for k in range(N_CLASSES)]
    identity = tuple(range(N_STATES))
    functions = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(functions)
                todo.append(h)
    every = np.array(list(functions), np.int64)
    number = every @ (N_STATES ** np.arange(N_STATES))
    order = np.argsort(number)
    composed = every[np.arange(len(every))[None, :, None], every[:, None, :]] @ (N_STATES ** np.arange(N_STATES))
    compose = order[np.searchsorted(number[order], composed)].astype(np.int32)
    of_class = np.array([functions[g] for g in base], np.int32)
    starts = np.array([[_step(s, k)[1] for k in range(N_CLASSES)] for s in range(N_STATES)])
    return of_class, compose, every.astype(np.uint8), starts


def prefix_compose(fs: np.ndarray, compose: np.ndarray, width: int = 64) -> np.ndarray:
    """Exclusive prefix composition: out[i] is the composition of fs[:i]."""
    n = len(fs)
    if n <= width:
        out = np.zeros(n, np.int32)
        now = 0
        for i in range(n):
            out[i] = now
            now = compose[now, fs[i]]
        return out
    rows = -(-n // width)
    block = np.zeros(rows * width, np.int32)
    block[:n] = fs
    columns = np.ascontiguousarray(block.reshape(rows, width).T)
    flat, size = compose.ravel(), compose.shape[0]
    total = columns[0].copy()
    for j in range(1, width):
        total = flat[total * size + columns[j]]
    now = prefix_compose(total, compose, width)
    out = np.empty_like(columns)
    for j in range(width):
        out[j] = now
        now = flat[now * size + columns[j]]
    return out.T.reshape(-1)[:n]


def slice_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray, scan) -> np.ndarray:
    """True where a slice starts. ``points``: code points of texts one after
    the other, each text preceded by a separator at the places ``first``."""
    of_class, compose, maps, starts = scan
    kind = classes[points]
    kind[first] = BREAK
    blank = (kind == SPACE) | (kind == BLANK)
    after = np.empty(len(kind), bool)
    after[:-1] = ~blank[1:] & (kind[1:] != BREAK)
    after[-1] = False
    last = blank & after
    # quotes that can open a contraction, by the code points that follow
    quotes = np.flatnonzero((points[:-1] == ord("'")) & (kind[:-1] != BREAK))
    one = points[quotes + 1]
    two = points[np.minimum(quotes + 2, len(points) - 1)]
    fits = np.isin(one, [ord(c) for c in CONTRACT_ONE]) & (kind[quotes + 1] != BREAK)
    pairs = np.zeros(len(quotes), bool)
    for a, b in CONTRACT_TWO:
        pairs |= (one == ord(a)) & (two == ord(b)) & (kind[np.minimum(quotes + 2, len(points) - 1)] != BREAK)
    kind[last & (kind == SPACE)] = LAST_SPACE
    kind[last & (kind == BLANK)] = LAST_BLANK
    kind[quotes[fits]] = QUOTE_ONE
    kind[quotes[pairs]] = QUOTE_TWO
    before = maps[prefix_compose(of_class[kind], compose), S_START]
    return starts[before, kind]


def batch_slices(texts: list[str], classes: np.ndarray, scan) -> list[np.ndarray]:
    """Per text, the offsets (in code points) at which its slices start."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "\0" + "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flags = slice_starts(points, first, classes, scan)
    flags[first] = False
    places = np.flatnonzero(flags)
    cuts = np.searchsorted(places, np.concatenate([first, [len(points)]]))
    return [places[cuts[i]:cuts[i + 1]] - first[i] - 1 for i in range(len(texts))]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank, leftmost first, is joined
    until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once joined away
    prev = list(range(-1, n - 1))

    def rank(i: int):
        j = end[i]
        return ranks.get(piece[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # one of the two parts has changed
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            prev[stop] = i
            if (new := rank(i)) is not None:
                heapq.heappush(heap, (new, i, end[stop]))
        if (p := prev[i]) >= 0 and (new := rank(p)) is not None:
            heapq.heappush(heap, (new, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PairTable:
    """Which adjacent ids join to which id, as a sorted array of pair keys."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        keys, joined = [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.joined = np.array(joined, np.int32)[order]
        self.of_byte = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self.of_two = np.array([get(bytes([x, y]), NONE) for x in range(256) for y in range(256)], np.int32)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair joins to; NONE where it has no rank. Negative
        ids stand for "no part"."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.joined[at], NONE)


NONE = np.int32(2**31 - 1)


def merge_many(pieces: list[bytes], width: int, pairs: PairTable) -> list[bytes]:
    """Ids (packed) of many slices of at most ``width`` bytes at once: each
    round joins, in every slice, the leftmost pair of lowest rank."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    sizes = np.array([len(p) for p in pieces])
    column = np.arange(width)
    ids = np.where(column < sizes[:, None], pairs.of_byte[raw], -1).astype(np.int32)
    ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
    ranks = np.full((n, width), NONE, np.int32)
    ranks[:, :-1] = pairs.of_two[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
    ranks[column >= sizes[:, None] - 1] = NONE
    out = ids.copy()
    rows = np.arange(n)
    wide = np.arange(width + 1)
    while True:
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        going = best != NONE
        if not going.all():
            out[rows[~going]] = ids[~going]
            ids, ranks, at, best, rows = ids[going], ranks[going], at[going], best[going], rows[going]
        if not len(rows):
            break
        here = np.arange(len(rows))
        shift = np.minimum(wide + (wide > at[:, None]), width)
        ids = np.take_along_axis(ids, shift, axis=1)
        ids[:, -1] = -1
        ids[here, at] = best
        ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), axis=1)
        ranks[:, -1] = NONE
        ranks[here, at] = pairs.join(best, ids[here, at + 1])
        back = at > 0
        ranks[here[back], at[back] - 1] = pairs.join(ids[here[back], at[back] - 1], best[back])
    counts = (out >= 0).sum(axis=1)
    packed = out.astype("<u4")
    return [packed[i, :c].tobytes() for i, c in enumerate(counts.tolist())]


class Codec:
    """Encoder and decoder over a rank file, with a bounded slice cache."""

    def __init__(self, rank_file: str, cache_size: int = 400_000):
        with open(rank_file, "rb") as f:
            lines = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.bytes_of[r] = token
        self.pairs = PairTable(self.ranks)
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.classes, self.scan = class_table(), scan_tables()

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of new slices into the cache."""
        by_width: dict[int, list] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(b) > 64:
                self.cache[p] = np.array(merge_bytes(b, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(-(-len(b) // 8) * 8, []).append((p, b))
        for width, both in by_width.items():
            for k in range(0, len(both), 20_000):
                part = both[k:k + 20_000]
                self.cache.update(zip((p for p, _ in part), merge_many([b for _, b in part], width, self.pairs)))

    def encode_batch(self, texts: list[str]):
        """Per text: (ids as little-endian unsigned 32-bit bytes, slice offsets)."""
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        get = self.cache.get
        done, open_, missing = [], [], set()
        for k, (text, starts) in enumerate(zip(texts, batch_slices(texts, self.classes, self.scan))):
            cuts = starts.tolist()
            pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
            ids = list(map(get, pieces))
            done.append((ids, starts))
            if None in ids:
                open_.append((k, pieces))
                missing.update([p for p, i in zip(pieces, ids) if i is None])
        self._learn(missing)
        for k, pieces in open_:
            done[k] = (list(map(get, pieces)), done[k][1])
        for ids, starts in done:
            yield b"".join(ids), starts

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _chunks(values, most_chars: int):
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v)
        if size >= most_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def byte_bpe(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text",
             with_ids: bool = False) -> DataFrame:
    """Encode and decode every text. One row per input row: the id, n_tokens,
    n_slices, ids_sha256, decoded_sha256, and with ``with_ids`` also ids
    (array of int) and slice_offsets (array of int, in code points)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    more = ", ids array<int>, slice_offsets array<int>" if with_ids else ""
    state: dict[str, Codec] = {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if "codec" not in state:
            state["codec"] = Codec(rank_file)
        codec = state["codec"]
        n_tokens, n_slices, coded, decoded, ids, offsets = [], [], [], [], [], []
        for part in _chunks((v.as_py() or "" for v in b.column("text")), 1 << 20):
            for packed, starts in codec.encode_batch(part):
                n_tokens.append(len(packed) // 4)
                n_slices.append(len(starts))
                coded.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                    offsets.append(starts.astype(np.int32))
        columns = [b.column("id"), pa.array(n_tokens, pa.int64()), pa.array(n_slices, pa.int64()),
                   pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        names = ["id", "n_tokens", "n_slices", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))]
            names += ["ids", "slice_offsets"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, n_tokens bigint, n_slices bigint, ids_sha256 string, decoded_sha256 string{more}"
    return map_arrow(src, batch, schema)
