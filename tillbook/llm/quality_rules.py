"""Quality rules by weak supervision.

Each rule looks at per-document counts and votes 1 (good), 0 (bad) or
abstains (-1). Expectation-maximisation over all vote patterns estimates each
rule's accuracy and the share of good documents without any labels; a
document is kept if its posterior probability of being good is at least
``threshold``.

A document's features need its text only, so they are computed in Arrow
batches where the text lies. EM needs only how often each vote pattern occurs:
at most ``3 ** len(rules)`` counts, made by a map-side-combined aggregate, so
the figures cover all rows while the driver holds a table of bounded size.

Defined results: a null text has no words; it and the empty text have all
counts 0. Rows with null or repeated ids each get a row of their own. An empty
table gives an empty result. Columns other than id and text are not read, so
extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import document_key, keep_rows, map_arrow, stored, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_upper", "n_letters", "n_bangs", "n_distinct_words", "n_lines"]
WINDOW = 5


def _pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense ids of the pairs (exact: equal ids if and only if equal pairs)."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    two = _pair_ids(ids[:-1], ids[1:])
    four = _pair_ids(two[:-2], two[2:])
    windows = _pair_ids(four[:n], ids[WINDOW - 1:])
    again = np.bincount(windows)[windows] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _differing(a: str, b: str) -> int:
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    return int((x != y).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines, dup_lines, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            if line in lines:
                dup_lines += 1
            lines.add(line)
    low, up = text.lower(), text.upper()
    n_upper = _differing(text, low) if len(low) == len(text) else sum(c.isupper() for c in text)
    n_letters = _differing(low, up) if len(low) == len(up) else sum(c.lower() != c.upper() for c in text)
    return (len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS),
            dup_lines, repeated_words(ids), n_upper, n_letters, text.count("!"), len(seen), n_lines)


def count_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_text) and the counts, one row per input row."""
    src = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    id_type = src.schema["k_id"].dataType.simpleString()
    fields = ", ".join(f"{c} bigint" for c in COUNTS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_counts(t) for t in texts(b, "text")], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([b.column("k_id"), b.column("k_text"), *map(pa.array, rows.T)],
                                          names=["k_id", "k_text", *COUNTS])

    return map_arrow(src, batch, f"k_id {id_type}, k_text bigint, {fields}")


@dataclass(frozen=True)
class Rule:
    """A vote: ``good`` and ``bad`` are conditions on the counts; neither
    holding means the rule abstains."""
    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return (F.when(F.expr(self.bad), F.lit(0)).when(F.expr(self.good), F.lit(1))
                .otherwise(F.lit(-1)).cast("int"))


RULES = (
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("dup_lines", "n_lines >= 3 and n_dup_lines = 0", "n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "10 * n_upper <= n_letters and n_letters > 0", "10 * n_upper > 4 * n_letters"),
    Rule("bangs", "100 * n_bangs <= n_words and n_words > 0", "10 * n_bangs > 2 * n_words"),
    Rule("variety", "10 * n_distinct_words >= 3 * n_words and n_words >= 10", "10 * n_distinct_words < n_words and n_words >= 50"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words and n_words > 0",
         "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("length", "n_words >= 50", "n_words < 10"),
)

BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and, per rule, the vote probabilities:
    ``table[rule, vote, truth]`` with vote 0 bad, 1 good, 2 abstain."""
    prior: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = np.where(votes < 0, 2, votes)
        logs = np.log(self.table)
        both = np.log([1 - self.prior, self.prior]) + sum(logs[r, v[:, r]] for r in range(v.shape[1]))
        both -= both.max(axis=1, keepdims=True)
        p = np.exp(both)
        return p[:, 1] / p.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """Per rule: the chance that a vote that is cast is right."""
        right = self.table[:, 1, 1] * self.prior + self.table[:, 0, 0] * (1 - self.prior)
        cast = (self.table[:, :2, 1] * self.prior + self.table[:, :2, 0] * (1 - self.prior)).sum(axis=1)
        return right / np.maximum(cast, 1e-12)


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> VoteModel:
    """EM from majority votes. Ties and all-abstain patterns start at the
    prior 0.5. With no rows at all every vote is taken as equally likely."""
    n_rules = votes.shape[1]
    if not len(votes):
        return VoteModel(0.5, np.full((n_rules, 3, 2), 1 / 3))
    v = np.where(votes < 0, 2, votes)
    hot = np.stack([v == k for k in range(3)], axis=2).astype(float)
    n_bad, n_good = (votes == 0).sum(axis=1), (votes == 1).sum(axis=1)
    # one bad vote weighs as much as several good ones: rules vote "bad" only on clear signs
    good = np.where(n_bad == 0, np.where(n_good > 0, 0.95, 0.5), np.where(n_bad >= 2, 0.05, 0.2))
    model = None
    for _ in range(rounds):
        w = np.stack([counts * (1 - good), counts * good])
        table = np.einsum("tp,prk->rkt", w, hot) + smooth
        table /= table.sum(axis=1, keepdims=True)
        prior = (w[1].sum() + smooth) / (counts.sum() + 2 * smooth)
        model = VoteModel(float(prior), table)
        new = model.posterior(votes)
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return model


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per document: k_id, k_text, the counts, one vote_<rule> column
    per rule, p_good, base_failed and kept."""
    spark = docs.sparkSession
    votes = [f"vote_{r.name}" for r in rules]
    feats = stored(count_features(docs, id_col, text_col)
                   .select("*", *[r.vote().alias(c) for r, c in zip(rules, votes)]), "rules")
    patterns = feats.groupBy(*votes).count().toPandas()
    pattern_votes = patterns[votes].to_numpy(np.int64).reshape(-1, len(votes))
    model = fit_votes(pattern_votes, patterns["count"].to_numpy(float))
    p = model.posterior(pattern_votes) if len(patterns) else np.zeros(0)
    schema = ", ".join(f"{c} int" for c in votes) + ", p_good double"
    table = spark.createDataFrame([(*map(int, v), float(x)) for v, x in zip(pattern_votes, p)], schema)
    return (feats.join(F.broadcast(table), votes)  # at most 3 ** len(rules) rows
            .withColumn("base_failed", F.expr(BASE_FAILED))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns unchanged."""
    return keep_rows(docs, quality_rules(docs, id_col, text_col).filter("kept"), id_col, text_col)
