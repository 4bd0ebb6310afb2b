"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The text gets its dummy prefix, spaces become U+2581, and every code point is a
symbol. An agenda holds the adjacent symbol pairs whose joined string is a
piece, by score, the greatest first, then the leftmost; the pair on top is
joined, and the pairs with its new neighbours enter. An entry one of whose
symbols has changed meanwhile is dropped when it comes up. What no pair joins
any more is the result; a symbol that is no piece falls back to its bytes, or
to the unknown id (a run of those gives one).

Two code points that stand side by side in no piece are never joined, so a
text may be cut between them. In the usual vocabularies U+2581 follows no other
character, and line ends stand alone, which cuts texts into words; stretches of over ``LONG`` code points
(text without spaces) are cut further, by the table of all neighbours inside
pieces. The ids of a stretch are cached (a bounded number of entries); the new
stretches of a batch are merged side by side, each with an agenda of its own.

``library_differences`` holds the results against the sentencepiece library,
in Arrow batches.

Supported: BPE models, identity normalisation, with or without dummy prefix
and byte fallback, spaces kept; other models are refused. Defined results: a
null text is encoded as the empty one, no ids, decoded as the empty text; the
library's own decoding of id lists is followed, with U+FFFD for each byte that
is not part of a valid sequence. Equal rows give equal rows, an empty table an
empty one; other columns are not read. The agenda of a stretch of n code
points takes n log n steps, so a very long text without spaces is whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.byte_bpe import _chunks
from tillbook.llm.common import map_arrow

MARK = "▁"
# fixed values: piece types and field numbers of the model file
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_SURFACE, BPE = 3, 35, 44, 2
RULE_NAME, RULES, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 1, 2, 3, 4, 5
UNKNOWN_TEXT = " ⁇ "
LONG = 48
NONE = np.int32(2**31 - 1)


def wire_fields(data: bytes):
    """(field number, value) pairs of one protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a sentencepiece model file")
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[i:i + size]
        i += size


def byte_text(data: bytes) -> str:
    """UTF-8, with U+FFFD for every byte outside a valid sequence."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[i:i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class PairTable:
    """Which adjacent symbols join to which piece, as a sorted array of pair
    keys. Code points that are no piece get numbers of their own, beyond the
    pieces', so that joins with them are found as well."""

    def __init__(self, ids: dict[str, int], priority: dict[str, float], n_pieces: int):
        points = sorted({c for n in ids for c in n if c not in ids})
        symbols = ids | {c: n_pieces + k for k, c in enumerate(points)}
        # any other code point: one number that joins with nothing
        self.of_point = np.full(0x110000, n_pieces + len(points), np.int32)
        for c, number in symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = number
        order = np.unique(np.array([priority[n] for n in ids]), return_inverse=True)[1]
        joins = [(symbols[n[:k]] << 32 | symbols[n[k:]], number, place) for (n, number), place in zip(ids.items(), order.tolist())
                 for k in range(1, len(n)) if n[:k] in symbols and n[k:] in symbols]
        table = np.array(sorted(joins) or [(-1, -1, -1)], np.int64)
        self.keys, self.joins, self.places = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def _find(self, left: np.ndarray, right: np.ndarray):
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (left >= 0) & (right >= 0)

    def priority(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the pair's joined piece in the order of scores, equal for
        equal scores; NONE where the pair is no piece."""
        at, found = self._find(left, right)
        return np.where(found, self.places[at], NONE)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.joins[self._find(left, right)[0]]


class PieceModel:
    """Encoder and decoder over a model file, with a bounded cache."""

    def __init__(self, model_file: str, cache_size: int = 400_000):
        with open(model_file, "rb") as f:
            parts = list(wire_fields(f.read()))
        trainer, normal = ({k: v for n, m in parts if n == which for k, v in wire_fields(m)} for which in (TRAINER, NORMALIZER))
        if trainer.get(MODEL_TYPE, 1) != BPE:
            raise ValueError("not a merge-type (BPE) vocabulary")
        if normal.get(RULES) or normal.get(EXTRA_SPACES, 1) or not normal.get(ESCAPE, 1):
            raise ValueError("only identity normalisation that keeps spaces is supported")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        self.fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.unknown_text = trainer[UNKNOWN_SURFACE].decode() if UNKNOWN_SURFACE in trainer else UNKNOWN_TEXT
        self.kinds, self.names = [], []
        self.ids: dict[str, int] = {}
        self.priority: dict[str, float] = {}  # of joining to this piece; smallest first
        self.of_byte = [0] * 256
        for n, m in parts:
            if n != PIECES:
                continue
            piece = dict(wire_fields(m))
            name, kind, number = piece.get(1, b"").decode(), piece.get(3, NORMAL), len(self.names)
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                raise ValueError(f"piece type {kind} is not supported")
            if kind == NORMAL:
                self.ids[name] = number
                self.priority[name] = -struct.unpack("<f", piece.get(2, bytes(4)))[0]
            elif kind == BYTE:
                self.of_byte[int(name[1:-1], 16)] = number
            elif kind == UNKNOWN:
                self.unknown = number
            self.kinds.append(kind)
            self.names.append(name)
        self.surface = [{CONTROL: b"", UNKNOWN: self.unknown_text.encode()}.get(k, n.replace(MARK, " ").encode())
                        for k, n in zip(self.kinds, self.names)]
        for byte, number in enumerate(self.of_byte):
            if self.fallback:
                self.surface[number] = bytes([byte])
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.decimal = [str(i) for i in range(len(self.names))]
        alone = "".join(c for c in "\n\r\t" if not any(c in n for n in self.ids if len(n) > 1))
        cuttable = all(MARK not in n.lstrip(MARK) for n in self.ids)
        self.stretches = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")
                                    if cuttable else "(?s:.+)").findall
        self.pairs = PairTable(self.ids, self.priority, len(self.names))
        self.neighbours = np.unique(np.array([ord(a) << 21 | ord(b) for n in self.ids for a, b in zip(n, n[1:])], np.int64))
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def merge(self, s: str) -> bytes:
        """Ids (packed) of one stretch, by the agenda."""
        whole = self.ids.get(s) if len(s) == 1 else None
        if whole is not None:
            return whole.to_bytes(4, "little")
        priority, n = self.priority.get, len(s)
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once joined away
        before = list(range(-1, n - 1))
        agenda = [(p, i, i + 2) for i in range(n - 1) if (p := priority(s[i:i + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, stop = pop(agenda)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                last = end[stop]
                if (p := priority(s[i:last])) is not None:
                    push(agenda, (p, i, last))
            h = before[i]
            if h >= 0 and (p := priority(s[h:stop])) is not None:
                push(agenda, (p, h, stop))
        out, i = [], 0
        while i < n:
            j = end[i]
            number = self.ids.get(s[i:j])
            if number is not None:
                out.append(number)
            elif self.fallback:
                out += [self.of_byte[b] for b in s[i:j].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
            i = j
        return np.array(out, "<u4").tobytes()

    def cut(self, s: str) -> list[str]:
        """``s`` cut between code points that no piece holds side by side."""
        if not len(self.neighbours):
            return list(s)
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
        ends = (np.flatnonzero(self.neighbours[at] != pairs) + 1).tolist()
        return [s[a:b] for a, b in zip([0, *ends], [*ends, len(s)])]

    def merge_many(self, stretches: list[str], width: int) -> list[bytes]:
        """Ids (packed) of many stretches of at most ``width`` code points,
        side by side: the agenda of each is a row of priorities, one a pair,
        and its top the row's smallest, leftmost entry."""
        n = len(stretches)
        sizes = np.array([len(s) for s in stretches])
        inside = np.arange(width) < sizes[:, None]
        points = np.zeros((n, width), np.int64)
        points[inside] = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :-1][inside] = self.pairs.of_point[points[inside]]
        agenda = np.full((n, width), NONE, np.int32)
        agenda[:, :-1] = self.pairs.priority(ids[:, :-2], ids[:, 1:-1])
        done, rows, wide = ids.copy(), np.arange(n), np.arange(width + 1)
        while True:
            top = agenda.argmin(axis=1)
            going = agenda[np.arange(len(rows)), top] != NONE
            if not going.all():
                done[rows[~going]] = ids[~going]
                ids, agenda, top, rows = ids[going], agenda[going], top[going], rows[going]
            if not len(rows):
                break
            here = np.arange(len(rows))
            joined = self.pairs.joined(ids[here, top], ids[here, top + 1])
            moved = np.minimum(wide + (wide > top[:, None]), width)
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[:, -1] = -1
            ids[here, top] = joined
            agenda = np.take_along_axis(agenda, np.minimum(moved[:, :-1], width - 1), axis=1)
            agenda[:, -1] = NONE
            agenda[here, top] = self.pairs.priority(joined, ids[here, top + 1])
            back = top > 0
            agenda[here[back], top[back] - 1] = self.pairs.priority(ids[here[back], top[back] - 1], joined[back])
        out = []
        odd = ((done >= len(self.names)).any(axis=1)).tolist()
        packed = done.astype("<u4")
        for i, c in enumerate((done >= 0).sum(axis=1).tolist()):
            # a symbol that is no piece: the single agenda knows its bytes
            out.append(self.merge(stretches[i]) if odd[i] else packed[i, :c].tobytes())
        return out

    def learn(self, stretches: set[str]) -> None:
        """Put the ids of stretches into the cache."""
        by_width: dict[int, list[str]] = {}
        for s in stretches:
            if len(s) <= LONG:
                by_width.setdefault(-(-len(s) // 4) * 4, []).append(s)
            else:
                parts = self.cut(s)
                self.learn({p for p in parts if len(p) <= LONG and p not in self.cache})
                self.cache[s] = b"".join([self.cache[p] if len(p) <= LONG else self.merge(p) for p in parts])
        for width, same in by_width.items():
            for k in range(0, len(same), 20_000):
                part = same[k:k + 20_000]
                self.cache.update(zip(part, self.merge_many(part, width)))

    def encode_batch(self, texts: list[str]):
        """The ids of every text."""
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        get, lists, missing = self.cache.get, [], set()
        for text in texts:
            marked = text.replace(" ", MARK)
            pieces = self.stretches(MARK + marked if self.prefix else marked) if text else []
            packed = list(map(get, pieces))
            if None in packed:
                missing.update([p for p, got in zip(pieces, packed) if got is None])
                lists.append((pieces, None))
            else:
                lists.append((None, packed))
        self.learn(missing)
        for pieces, packed in lists:
            ids = np.frombuffer(b"".join(packed if pieces is None else map(get, pieces)), "<u4")
            if not self.fallback and len(ids):
                unknown = ids == self.unknown
                ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
            yield ids.tolist()
        for s in [s for s in missing if len(s) > LONG]:
            del self.cache[s]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> str:
        lead = 0
        while lead < len(ids) and self.kinds[ids[lead]] == CONTROL:
            lead += 1
        data = [self.surface[i] for i in ids[lead:]]
        if self.prefix and data and self.kinds[ids[lead]] == NORMAL and self.names[ids[lead]].startswith(MARK):
            data[0] = data[0][1:]  # the dummy prefix
        if self.controls.isdisjoint(ids):
            try:
                return b"".join(data).decode()
            except UnicodeDecodeError:
                pass
        # only runs of byte pieces can be invalid; each is read by itself, and a control id ends it
        out, run = [], []
        for i, d in zip(ids[lead:], data):
            if self.kinds[i] == BYTE:
                run.append(d)
                continue
            out += [byte_text(b"".join(run)), d.decode()]
            run = []
        return "".join([*out, byte_text(b"".join(run))])


def sentence_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                    with_ids: bool = False) -> DataFrame:
    """Encode and decode every text. One row per input row: id, n_tokens,
    ids_sha256 (of the decimal ids, joined by commas), decoded_sha256, and
    with ``with_ids`` also the ids and the decoded text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    state: dict[str, PieceModel] = {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if "model" not in state:
            state["model"] = PieceModel(model_file)
        model = state["model"]
        counts, coded, decoded, ids, texts = [], [], [], [], []
        for part in _chunks((v.as_py() or "" for v in b.column("text")), 1 << 20):
            for one in model.encode_batch(part):
                back = model.decode(one)
                counts.append(len(one))
                coded.append(hashlib.sha256(",".join(map(model.decimal.__getitem__, one)).encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append(one)
                    texts.append(back)
        columns = [b.column("id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {src.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}"
    return map_arrow(src, batch, schema)


def library_differences(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose ids or decoded text differ from the sentencepiece library's,
    batch by batch: id, ids, library_ids, decoded, library_decoded."""
    ours = sentence_pieces(docs.select(F.struct(id_col, text_col).alias("both"), F.col(text_col).alias("text")), model_file,
                           "both", "text", with_ids=True).select(
        F.col(f"id.{id_col}").alias("id"), F.col(f"id.{text_col}").alias("text"), "ids", "decoded")
    state: dict = {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if "library" not in state:
            import sentencepiece

            state["library"] = sentencepiece.SentencePieceProcessor(model_file=model_file)
        library = state["library"]
        theirs = library.encode([t or "" for t in b.column("text").to_pylist()], num_threads=1)
        back = [library.decode(i) for i in theirs]
        out = pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("ids"), pa.array(theirs, pa.list_(pa.int32())), b.column("decoded"), pa.array(back, pa.string())],
            names=["id", "ids", "library_ids", "decoded", "library_decoded"])
        differ = [x != y or p != q for x, y, p, q in zip(b.column("ids").to_pylist(), theirs, b.column("decoded").to_pylist(), back)]
        return out.filter(pa.array(differ, pa.bool_()))

    id_type = ours.schema["id"].dataType.simpleString()
    return map_arrow(ours, batch, f"id {id_type}, ids array<int>, library_ids array<int>, decoded string, library_decoded string")
