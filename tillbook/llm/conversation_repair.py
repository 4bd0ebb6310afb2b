"""Conversation structure repair: the cheapest edits that make a conversation
read as an optional system turn and then pairs of user and assistant.

Method (Knuth's lightest derivation). An item is (rows read, grammar state); a
repair step is a weighted deduction from one item to the next: keep a row,
change its role, delete it, or insert an empty turn. An agenda holds derived
items by (cost, rows read, audit); every step's function is superior (a step
either costs something or reads a row) and monotone (two audits of equal cost
that read the same rows are never prefixes of each other, so a letter behind
both keeps their order). The item on top is therefore final, and the first goal
item popped is the answer: least cost, ties to the smaller audit string.

On Spark: rows are dealt by ranges of (conversation, turn), so a conversation
that holds a third of all rows is spread over tasks too. Each task streams its
rows in blocks of at most ``BLOCK_ROWS`` rows of one conversation. A block that
is a whole conversation is answered on the spot. Any other gives the lightest
derivation from every state to every state; those 4 x 4 tables are composed
pairwise per conversation, cut back into one audit per block, and each block is
repaired by itself. What stays in one task per conversation is the composition
of its blocks' audits and the SHA-256 of its repaired text, which is streamed.

Duplicate detection joins each row with the first turn of its (conversation,
role, text) where that occurs more than once; Spark broadcasts that side only
when its measured size allows, and splits hot keys otherwise.

Defined results: null roles and texts are read as one space (so such a role
fits no state, such a text is blank); an empty role has no initial and fits no
state either. Null ids form one conversation. Rows of equal turn are ordered by
role and text; equal rows repeat the first and are duplicates. Null turns come
first and count in no gap. A conversation without rows has zeros, an empty
audit and the hash of the empty text; an empty table gives no row. Texts of any
length are read whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import stored

BLOCK_ROWS = 2048
BLOCK_CHARS = 1 << 22
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
# what a kept row of an initial leads to; what an inserted or renamed row leads to
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = ".bdt"


def lightest(initials: list[str], faults: list[str], entry: int, goals=()) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivation from state ``entry`` over all
    rows, by final state; only the lightest goal where ``goals`` are named."""
    n = len(initials)
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", entry)]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    push = heapq.heappush
    while agenda:
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            found[state] = (cost, audit)
            if state in goals:
                return {state: found[state]}
            if len(found) == 4:
                break
        else:
            push(agenda, (cost + DELETE, i + 1, audit + "D", state))
            fault = faults[i]
            if fault != BLANK and fault != DUPLICATE:
                extra = cost + (CUT if fault == TRUNCATED else 0)
                kept = KEEPS.get((state, initials[i]))
                if kept is not None:
                    push(agenda, (extra, i + 1, audit + "K", kept))
                push(agenda, (extra + RENAME, i + 1, audit + "R", NEXT[state]))
        push(agenda, (cost + INSERT, i, audit + "I", NEXT[state]))
    return found


def compose(tables: list[dict]) -> dict:
    """Lightest derivations over blocks that follow each other, from tables
    {(state, state): (cost, audit)}, joined pairwise."""
    while len(tables) > 1:
        joined = []
        for left, right in zip(tables[::2], tables[1::2]):
            both: dict = {}
            for (a, b), (c1, s1) in left.items():
                for d in range(4):
                    if (b, d) in right:
                        c2, s2 = right[b, d]
                        new = (c1 + c2, s1 + s2)
                        if (a, d) not in both or new < both[a, d]:
                            both[a, d] = new
            joined.append(both)
        tables = joined + tables[len(joined) * 2:]
    return tables[0]


def apply_audit(roles: list[str], texts: list[str], audit: str, state: int) -> list[tuple[str, str]]:
    """The repaired rows."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            state = KEEPS[state, roles[i][:1]]
            out.append((roles[i], texts[i]))
        else:
            state = NEXT[state]
            out.append((ROLE[state], "" if edit == "I" else texts[i]))
        i += edit != "I"
    return out


def state_after(outputs: int, total: int) -> int:
    """Grammar state after so many of ``total`` repaired rows; their number is
    odd exactly where a system turn leads."""
    if not outputs:
        return START
    odd = total % 2
    if odd and outputs == 1:
        return SYSTEM
    return USER if (outputs - odd) % 2 else ASSISTANT


def cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """One audit per block of so many rows."""
    cuts, at = [], 0
    for size in sizes:
        begin, rows = at, 0
        while rows < size:
            rows += audit[at] != "I"
            at += 1
        cuts.append(audit[begin:at])
    cuts[-1] += audit[at:]
    return cuts


def lines(repaired: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in repaired).encode()


class Block:
    """Rows of one conversation in order."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens, self.empty = conv, opens, True
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[str] = []
        self.chars = self.n_turns = self.illegal = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        bare = text.rstrip(WHITE)
        self.faults.append(BLANK if not bare else DUPLICATE if seen else FINE if bare[-1] in ".!?" else TRUNCATED)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        if turn is not None:
            self.n_turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def row(self, number: int, closes: bool, with_rows: bool) -> dict:
        done = self.opens and closes
        initials = [r[:1] for r in self.roles]
        out = {"conv": self.conv, "block": number, "done": done, "n_rows": len(self.roles), "low": self.low, "high": self.high,
               "n_turns": self.n_turns, "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE),
               "truncated": self.faults.count(TRUNCATED), "illegal": self.illegal,
               "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None}
        if done:
            (cost, audit), = lightest(initials, self.faults, START, ACCEPTED).values()
            out |= {"cost": cost, "audit": audit, "sha256": hashlib.sha256(lines(apply_audit(self.roles, self.texts, audit, START))).hexdigest()}
        else:
            out["paths"] = [f"{a} {b} {cost} {audit}" for a in ((START,) if self.opens else range(4))
                            for b, (cost, audit) in lightest(initials, self.faults, a).items()]
        if with_rows or not done:
            out |= {"roles": self.roles, "texts": self.texts}
        return out


BLOCK_FIELDS = ("block bigint, done boolean, n_rows bigint, low bigint, high bigint, n_turns bigint, blank bigint, duplicate bigint, "
                "truncated bigint, illegal bigint, first_initial string, last_initial string, cost bigint, audit string, "
                "sha256 string, paths array<string>, roles array<string>, texts array<string>")
ARROW_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The rows with test damage, by CRC-32 of "conversation:turn" modulo 20:
    0 drops the row (it stays as a mark, ``present`` false), 1 empties its
    text, 2 removes its full stops, exclamation and question marks, 3 repeats
    it, 4 sets its role to user. Nulls are read as one space."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    src = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), kind.alias("kind"),
                               spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    return src.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def plain_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """The rows as they are; nulls in role and text are read as one space."""
    return conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), F.lit(True).alias("present"))


def _blocks(rows: DataFrame, with_rows: bool) -> DataFrame:
    """Blocks of consecutive rows of one conversation, as a stored table."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("k", F.sha2(F.to_json(F.struct("conv", "role", "text")), 256))
    firsts = (keyed.where("present").groupBy(F.col("k").alias("k_first")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    flagged = keyed.join(firsts, keyed["k"] == firsts["k_first"], "left").select(
        "conv", "turn", "role", "text", "present", F.coalesce(F.col("first") < order, F.lit(False)).alias("seen"))
    dealt = flagged.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    names = [f.split(" ")[0] for f in BLOCK_FIELDS.split(", ")]
    types = [ARROW_TYPES[f.split(" ", 1)[1]] for f in BLOCK_FIELDS.split(", ")]
    conv_type = rows.schema["conv"].dataType

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        number = TaskContext.get().partitionId() << 32
        now, last, out, conv_arrow = None, None, [], to_arrow_type(conv_type)

        def flush():
            columns = [pa.array([r["conv"] for r in out], conv_arrow)]
            columns += [pa.array([r.get(n) for r in out], t) for n, t in zip(names, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", *names])

        def close(closes):
            nonlocal number
            out.append(now.row(number, closes, with_rows))
            number += 1

        size = 0
        for b in batches:
            for conv, turn, role, text, present, seen in zip(*(c for c in b.columns)):
                conv = conv.as_py()
                if now is None or now.conv != conv or now.full():
                    same = now is not None and now.conv == conv
                    if now is not None:
                        close(not same)
                        size += now.chars
                        if len(out) >= 1000 or size >= BLOCK_CHARS:
                            yield flush()
                            size = 0
                    # the first conversation of a task may begin in the one before
                    now = Block(conv, now is not None and not same)
                    last = last if same else None
                if present.as_py():
                    row = (turn.as_py(), role.as_py(), text.as_py())
                    now.add(*row, seen.as_py() or row == last)
                    last = row
        if now is not None:
            close(False)  # may go on in the next task
        if out:
            yield flush()

    schema = f"conv {conv_type.simpleString()}, {BLOCK_FIELDS}"
    return stored(dealt.mapInArrow(run, schema), "conversation-blocks")


def _slices(blocks: DataFrame) -> DataFrame:
    """For blocks that are not a whole conversation: the conversation's first
    block, the state at which the block begins, the repaired rows before it and
    its audit; in the first block's row also the conversation's figures."""
    fields = ("block bigint, head bigint, state bigint, outputs bigint, piece string, gaps bigint, blank bigint, duplicate bigint, "
              "truncated bigint, illegal bigint, cost bigint, audit string")
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        tables = []
        for paths in pdf["paths"]:
            split = (p.split(" ") for p in paths)
            tables.append({(int(a), int(b)): (int(c), s) for a, b, c, s in split})
        whole = compose(tables)
        cost, audit = min(v for (a, b), v in whole.items() if a == START and b in ACCEPTED)
        pieces = cut_audit(audit, [int(n) for n in pdf["n_rows"]])
        total = len(audit) - audit.count("D")
        illegal, before, turns, high, low = int(pdf["illegal"].sum()), None, 0, None, None
        for r in pdf.itertuples():
            if r.n_rows:
                illegal += before is not None and before + r.first_initial not in ("su", "ua", "au")
                before = r.last_initial
            if r.n_turns:
                turns += int(r.n_turns) - (high == int(r.low))
                low, high = int(r.low) if low is None else low, int(r.high)
        gaps = high - low + 1 - turns if turns else 0
        out, outputs = [], 0
        for block, piece in zip(pdf["block"], pieces):
            figures = (None,) * 7 if out else (gaps, int(pdf["blank"].sum()), int(pdf["duplicate"].sum()), int(pdf["truncated"].sum()),
                                               illegal, cost, audit)
            out.append((int(block), int(pdf["block"].iloc[0]), state_after(outputs, total), outputs, piece, *figures))
            outputs += len(piece) - piece.count("D")
        return pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names if n not in ("piece", "audit")})

    need = blocks.where("not done").select("conv", "block", "n_rows", F.col("low").cast("string").alias("low"),
                                           F.col("high").cast("string").alias("high"), "n_turns", "blank", "duplicate", "truncated",
                                           "illegal", "first_initial", "last_initial", "paths")
    return stored(need.groupBy("conv").applyInPandas(one, fields), "conversation-slices")


def _long_hashes(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """SHA-256 of the repaired text of conversations of several blocks: blocks
    become text by themselves, then each conversation's are streamed in order."""
    joined = blocks.where("not done").select("block", "roles", "texts").join(slices.select("block", "head", "state", "piece"), "block")

    def chunks(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("head"), b.column("block"),
                 pa.array([lines(apply_audit(r["roles"], r["texts"], r["piece"], r["state"])) for r in rows], pa.binary())],
                names=["head", "block", "data"])

    def hashes(batches):
        head, digest, empty, out = None, None, True, []
        for b in batches:
            for h, data in zip(b.column("head").to_pylist(), b.column("data")):
                if h != head:
                    if head is not None:
                        out.append((head, digest.hexdigest()))
                    head, digest, empty = h, hashlib.sha256(), True
                data = data.as_py()
                if data:
                    digest.update(data if empty else b"\n" + data)
                    empty = False
        if head is not None:
            out.append((head, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())],
                                         names=["head", "sha256"])

    text = joined.mapInArrow(chunks, "head bigint, block bigint, data binary")
    return text.repartition("head").sortWithinPartitions("head", "block").mapInArrow(hashes, "head bigint, sha256 string")


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (from ``plain_rows`` or
    ``damage``): conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    blocks = _blocks(rows, with_rows=False)
    slices = _slices(blocks)
    short = blocks.where("done").select(
        "conv", F.when(F.col("n_turns") > 0, F.col("high") - F.col("low") + 1 - F.col("n_turns")).otherwise(0).alias("gaps"),
        *FIGURES[1:], F.col("sha256").alias("repaired_sha256"))
    heads = slices.where("audit is not null").select("block", *FIGURES)
    long = (heads.join(blocks.select("block", "conv"), "block").join(_long_hashes(blocks, slices).withColumnRenamed("head", "block"), "block")
            .select("conv", *FIGURES, F.col("sha256").alias("repaired_sha256")))
    return short.unionByName(long)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv, position (from 0), role, text."""
    blocks = _blocks(rows, with_rows=True)
    slices = _slices(blocks)
    whole = blocks.where("done").select("conv", "roles", "texts", F.lit(START).cast("bigint").alias("state"),
                                        F.lit(0).cast("bigint").alias("outputs"), F.col("audit").alias("piece"))
    parts = blocks.where("not done").select("block", "conv", "roles", "texts").join(
        slices.select("block", "state", "outputs", "piece"), "block").select("conv", "roles", "texts", "state", "outputs", "piece")

    def run(batches):
        for b in batches:
            found = [apply_audit(r["roles"], r["texts"], r["piece"], r["state"])
                     for r in b.select(["roles", "texts", "piece", "state"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("outputs"), pa.array([[r for r, _ in f] for f in found], pa.list_(pa.string())),
                 pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))], names=["conv", "outputs", "roles", "texts"])

    conv_type = rows.schema["conv"].dataType.simpleString()
    mended = whole.unionByName(parts).mapInArrow(run, f"conv {conv_type}, outputs bigint, roles array<string>, texts array<string>")
    return (mended.select("conv", "outputs", F.posexplode(F.arrays_zip("roles", "texts")))
            .select("conv", (F.col("outputs") + F.col("pos")).alias("position"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text")))
