"""SentencePiece, conversation repair and periodic runs: against the library,
against brute force, and on odd rows."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from tests.conftest import SF_DIR
from tests.llm.test_operators import ODD, SCHEMA, docs, empty, odd, prose  # noqa: F401  (fixtures)

WHITE = " \t\n\x0b\x0c\r"


def key(v):
    return None if v is None or pd.isna(v) else int(v)


# SentencePiece

SIGNS = [" ", "  ", "▁", "\n", "\t", "\0", "\r\n", "a", "the", "ing", "é", "é", "漢", "한", "🙂", "<s>", "</s>", "<unk>", "<0x41>",
         "�", "\U0010ffff", "​", "﻿", "\xa0", "'s"]


@pytest.fixture(scope="module")
def model_file(spark):
    from tillbook.llm.vocabularies import vocabulary

    return vocabulary(spark, "piece_bpe_32k.model")


def test_pieces_equal_library(model_file):
    import sentencepiece

    from tillbook.llm.sentence_pieces import PieceModel

    ours, library = PieceModel(model_file, cache_size=500), sentencepiece.SentencePieceProcessor(model_file=model_file)
    rng = random.Random(7)

    def text():
        return "".join(rng.choice(SIGNS) if rng.random() < 0.7 else chr(rng.choice(
            [rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(60)))

    texts = [text() for _ in range(4000)] + ["a" * 30_000, " " * 3000, "漢字" * 5000, "x" * 47 + "é" * 3, prose(5, 20_000)]
    for ids, want, t in zip(ours.encode_batch(texts), library.encode(texts), texts):
        assert ids == want, t[:80]
        assert ours.decode(ids) == library.decode(want)
    for _ in range(5000):  # any id list, invalid byte runs and control ids too
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), rng.randrange(190, 259), 259])
               for _ in range(rng.randrange(9))]
        assert ours.decode(ids) == library.decode(ids)


def test_single_agenda_equals_side_by_side(model_file):
    from tillbook.llm.sentence_pieces import LONG, PieceModel

    model = PieceModel(model_file)
    rng = random.Random(9)
    words = ["▁" * rng.randrange(4) + "".join(rng.choices("aeinrst漢ø؀", k=rng.randrange(1, LONG - 4))) for _ in range(2000)]
    assert model.merge_many(words, LONG) == [model.merge(w) for w in words]


def test_pieces_table(spark, docs, odd, empty, model_file):  # noqa: F811
    from tillbook.llm.sentence_pieces import library_differences, sentence_pieces

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for frame in (docs, odd):
        src = frame.select("doc_id", "text").collect()
        want = collections.Counter()
        for i, t in src:
            ids = library.encode(t or "")
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
        got = collections.Counter(tuple(r) for r in sentence_pieces(frame, model_file).collect())
        assert got == want
        assert library_differences(frame, model_file).count() == 0
    full = sentence_pieces(odd, model_file, with_ids=True).collect()
    assert all(r.decoded == (dict(enumerate(ODD)).get(r.id) or r.decoded or "") or r.id in (8, None) for r in full)
    assert sentence_pieces(empty, model_file).count() == 0 and library_differences(empty, model_file).count() == 0


def test_other_models_are_refused(tmp_path, model_file):
    from tillbook.llm.sentence_pieces import PieceModel, byte_text

    data = open(model_file, "rb").read()
    (tmp_path / "unigram.model").write_bytes(data.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))
    with pytest.raises(ValueError):
        PieceModel(str(tmp_path / "unigram.model"))
    assert byte_text(b"\xe6\xbc\xa2\xe6\xbca") == "漢��a"


# periodic runs


def brute_lyndon(x):
    return [max(j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))) for i in range(len(x))]


def brute_runs(x, exponent=4, shortest=6):
    found = set()
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i + p < len(x):
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            n = i + p - s
            if i > s and n >= max(shortest, exponent * p) and not any(x[s:s + n - q] == x[s + q:s + n] for q in range(1, p)):
                found.add((s, n, p))
            i += 1
    return sorted(found)


def words_of(rng, n, kinds, noise):
    p = rng.randint(1, 9)
    base = [f"w{rng.randrange(kinds)}" for _ in range(max(n, p))]
    return [base[k % p] if rng.random() > noise else f"w{rng.randrange(kinds)}" for k in range(n)]


def test_lyndon_arrays():
    from tillbook.llm.periodic_runs import lyndon_array

    rng = random.Random(2)
    for _ in range(1500):
        x = [int(w[1:]) for w in words_of(rng, rng.randint(1, 22), rng.randint(1, 4), rng.choice([0, 0.05, 1]))]
        x = [sorted(set(x)).index(v) for v in x]
        assert lyndon_array(x, max(x) + 1) == brute_lyndon(x)
    assert lyndon_array([0] * 5000, 1) == [1] * 5000


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 1)])
def test_runs_equal_brute_force(exponent, shortest):
    from tillbook.llm.periodic_runs import block_runs

    rng = random.Random(exponent)
    for _ in range(500):
        block = [[w.encode() for w in words_of(rng, rng.randint(0, 70), rng.randint(1, 5), rng.choice([0, 0.02, 0.1, 1]))]
                 for _ in range(rng.randint(1, 4))]
        for words, runs in zip(block, block_runs(block, exponent, shortest)):
            assert [tuple(r) for r in runs.tolist()] == brute_runs(words, exponent, shortest)


def brute_run_row(i, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    if plant and i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2])) if runs else None
    dropped = {k for s, ln, p in runs for k in range(s + p, s + ln)}
    return (i, n, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{ln},{p}\n" for s, ln, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest())


def test_runs_table(spark, docs, odd, empty):  # noqa: F811
    from tillbook.llm.periodic_runs import periodic_runs

    short = docs.where("n_chars < 3000")
    planted = spark.createDataFrame([(i, prose(i, 3 + i % 60)) for i in range(400)], "doc_id long, text string")
    for frame in (short, odd, planted):
        for plant in (False, True):
            got = collections.Counter(tuple(r) for r in periodic_runs(frame, plant=plant).collect())
            assert got == collections.Counter(brute_run_row(r.doc_id, r.text, plant) for r in frame.select("doc_id", "text").collect())
    assert sum(r.n_runs for r in periodic_runs(planted, plant=True).collect()) > 10
    assert periodic_runs(empty, plant=True).count() == 0
    long = spark.createDataFrame([(1, "x y " * 100_000 + prose(3, 100_000)), (2, "z " * 200_000)], "doc_id long, text string")
    rows = {r.id: r for r in periodic_runs(long, with_runs=True).collect()}
    assert rows[1].runs == [[0, 200_000, 2]] and rows[1].collapsed == "x y " + prose(3, 100_000)
    assert rows[2].runs == [[0, 200_000, 1]] and rows[2].collapsed == "z" and rows[2].exponent_milli == 200_000_000


# conversation repair

TURNS = "conv_id long, turn long, role string, text string, block long, seen string, conv string"


def brute_damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Lightest edits by plain recursion from the end; rows are in order."""
    faults, n = faults_of(rows), len(rows)

    @functools.cache
    def best(i, state, inserts):
        # state: the pattern read so far, "" or its last letter
        options = [(0, "")] if i == n and state in ("", "a") else []

        def go(cost, letter, j, new, k=0):
            rest = best(j, new, k)
            if rest:
                options.append((cost + rest[0], letter + rest[1]))

        after = "a" if state == "u" else "u"
        if inserts < 2:
            go(2, "I", i, after, inserts + 1)
        if i < n:
            go(3, "D", i + 1, state)
            if faults[i] not in "bd":
                extra, first = int(faults[i] == "t"), rows[i][2][:1]
                if first and state + first in ("s", "u", "su", "ua", "au"):
                    go(extra, "K", i + 1, first)
                go(2 + extra, "R", i + 1, after)
        return min(options) if options else None

    for i in range(n, -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            for k in (2, 1, 0):
                best(i, state, k)
    return best(0, "", 0)


def brute_summary(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults = faults_of(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = brute_repair(rows)
    out, i = [], 0
    for e in audit:
        # a system turn leads exactly where the number of repaired rows is odd
        role = ("user", "assistant")[(len(out) - (len(audit) - audit.count("D")) % 2) % 2]
        if e == "K":
            out.append(f"{rows[i][2]}:{rows[i][3]}")
        elif e != "D":
            out.append(f"{role}:{'' if e == 'I' else rows[i][3]}")
        i += e != "I"
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def brute_table(source, damaged=True):
    groups = {r[0]: [] for r in source}
    for r in brute_damage(source) if damaged else ((c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in source):
        groups[r[0]].append(r)
    return {c: brute_summary(c, rows) for c, rows in groups.items()}


def test_lightest_equals_all_edit_strings():
    """Against every edit string up to a length."""
    from tillbook.llm.conversation_repair import ACCEPTED, START, lightest

    rng = random.Random(4)
    for _ in range(120):
        n = rng.randint(0, 3)
        initials = rng.choices(["s", "u", "a", "x", ""], [3, 5, 5, 1, 1], k=n)
        faults = rng.choices(".bdt", [5, 1, 1, 2], k=n)
        best = None
        for size in range(n, n + 4):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in audit) != n:
                    continue
                i, cost, shown = 0, 0, [""]
                for e in audit:
                    if e == "I":
                        shown = [s + r for s in shown for r in "ua"]
                        cost += 2
                        continue
                    if e == "D":
                        cost += 3
                    elif faults[i] in "bd" or (e == "K" and not initials[i]):
                        shown = []
                    else:
                        cost += (2 if e == "R" else 0) + (faults[i] == "t")
                        shown = [s + initials[i] for s in shown] if e == "K" else [s + r for s in shown for r in "ua"]
                    i += 1
                if any(re.fullmatch("(s?(ua)+)?", s) for s in shown):
                    best = min(best or (99, ""), (cost, "".join(audit)))
        assert min(lightest(initials, faults, START, ACCEPTED).values()) == best


def random_turns(rng, convs, most):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
                         rng.choice(["Yes.", "No", " ", "Why?", f"Text {rng.randrange(9)}.", f"open {rng.randrange(9)} ", "é!\n"])))
    return rows


def test_repair_equals_brute_force(spark):
    from tillbook.llm.conversation_repair import damage, plain_rows, repair_conversations, repaired_rows

    rng = random.Random(11)
    source = random_turns(rng, 150, 9)
    source += [(1000, None, "user", "Hi."), (1000, None, None, None), (1000, 3, "assistant", "Yes."), (1000, 3, "assistant", "Yes."),
               (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (1001, None, None, None), (1002, 5, "user", "")]
    frame = spark.createDataFrame([(*r, 7, "x", "y") for r in source], TURNS)
    for damaged in (True, False):
        rows = damage(frame) if damaged else plain_rows(frame)
        want = brute_table(source, damaged)
        got = {r[0]: tuple(r) for r in repair_conversations(rows).collect()}
        assert len(got) == len(want) and got == {c: w for c, (w, _) in want.items()}
        mended = {c: [] for c in want}
        for r in repaired_rows(rows).orderBy("conv", "position").collect():
            assert r.position == len(mended[r.conv])
            mended[r.conv].append(f"{r.role}:{r.text}")
        assert mended == {c: out for c, (_, out) in want.items()}


def test_repair_of_long_conversations(spark, monkeypatch):
    """Conversations of many blocks, spread over tasks."""
    from tillbook.llm import conversation_repair

    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    rows = [(3, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "", f"C {t}.", f"D {t}"])) for t in range(400)]
    rows += [(3, None, "system", "Start.")] + random_turns(rng, 3, 60)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = brute_table(rows)
    damaged = conversation_repair.damage(frame)
    assert {r[0]: tuple(r) for r in conversation_repair.repair_conversations(damaged).collect()} == {c: w for c, (w, _) in want.items()}
    mended = conversation_repair.repaired_rows(damaged).where("conv = 3").orderBy("position").collect()
    assert [f"{r.role}:{r.text}" for r in mended] == want[3][1]


def test_repair_of_the_table(spark):
    from tillbook.llm.queries import QUERIES

    source = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r) for r in QUERIES["op12_conversation_repair"](spark, SF_DIR).collect()}
    assert got == {c: w for c, (w, _) in brute_table(source).items()}


def test_repair_of_nothing(spark):
    from tillbook.llm.conversation_repair import damage, repair_conversations, repaired_rows

    none = spark.createDataFrame([], TURNS)
    assert repair_conversations(damage(none)).count() == 0 and repaired_rows(damage(none)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair_conversations(damage(spark.createDataFrame([(dropped, 0, "user", "Gone.", 1, "", "")], TURNS))).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    text = "word " * 400_000
    long = repair_conversations(damage(spark.createDataFrame([(1, 1, "user", text, 1, "", "")], TURNS))).collect()
    assert long[0].truncated == 1 and long[0].cost == 3


@pytest.mark.parametrize("name", ["op3_warc", "op8_minhash_near_dedup", "op12_conversation_repair", "op13_periodic_runs"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tillbook.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert collections.Counter(tuple(r) for r in got.select(want.columns).collect()) == collections.Counter(want.fetchall())
