"""Quality classifier by co-training.

Two views of a document: its text (shape and word statistics) and its page
metadata (source, language, length as stated). Each view has a logistic
model. A model starts from a bounded sample of labelled documents
(``max_labelled``); in each round every unlabelled document is scored by both
(once, into a stored table), and each view hands the other up to ``per_round``
(times the round) of the documents it is sure of as pseudo-labels, in the
classes' shares. Sure means: from this score on, the view's precision on
labelled documents held out from training is at least ``confidence`` and halves
the error of always naming the class; a view without such a score hands over
none. A view keeps what it was given only if it then judges the held-out
documents no worse. Both views are then calibrated on the held-out documents,
and combined as independent evidence.

Features are computed once, where the text lies, into a narrow stored table;
scoring runs over all of it every round. The driver fits two models of some
dozens of weights on the bounded sample; it never sees other rows than the
sample and the ``2 * per_round`` picks of a round, both drawn by a hash where
the rows lie, at a rate that follows from the count.

Defined results: a null text counts as the empty one; null metadata are values
of their own. Rows with null or repeated ids are scored like others. Where the
labels contradict each other, the greatest counts. Where the
labels hold one class only, every score is 1 or 0 by that class; without any
label every score is 0.5. A document is kept if its score is at least
``threshold``. An empty table gives an empty result. Columns that are named
but missing in the table count as null; others are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import document_key, keep_rows, stored

WORD_BUCKETS = 32
TEXT_SHAPE = 14
META_BUCKETS = 24


def text_view(text: str | None, buckets: dict[bytes, int]) -> np.ndarray:
    """Shape and hashed word frequencies of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(TEXT_SHAPE + WORD_BUCKETS, np.float32)
    if not words:
        return out
    n, size = len(words), max(len(text), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w in counts:
        if w not in buckets:
            if len(buckets) > 400_000:
                buckets.clear()
            buckets[w] = zlib.crc32(w) % WORD_BUCKETS
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(codes, minlength=256)
    lower, upper, digits = kinds[97:123].sum(), kinds[65:91].sum(), kinds[48:58].sum()
    marks = kinds[33:127].sum() - lower - upper - digits
    lines = [x for x in text.split("\n") if x.strip()]
    out[:TEXT_SHAPE] = [
        np.log1p(n), len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        upper / max(lower + upper, 1), digits / size, marks / size, kinds[33] / n,
        sum(int(kinds[ord(c)]) for c in "#*$%&|<>") / n, kinds[ord("|")] / n, (kinds[46] + kinds[44]) / n,
        len(raw) / n / 10, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines))]
    at = np.fromiter((buckets.get(w, 0) for w in counts), np.int64, len(counts))
    out[TEXT_SHAPE:] = np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), WORD_BUCKETS) / n
    return out


def meta_view(categories: list, number) -> np.ndarray:
    out = np.zeros(META_BUCKETS + 2, np.float32)
    for k, value in enumerate(categories):
        out[zlib.crc32(f"{k}={value}".encode()) % META_BUCKETS] += 1
    if number is None or number != number:
        out[META_BUCKETS] = 1
    else:
        out[META_BUCKETS + 1] = np.log1p(max(float(number), 0.0)) / 10
    return out


def view_features(docs: DataFrame, id_col: str, text_col: str, categories: list[str], number: str) -> DataFrame:
    have = set(docs.columns)
    cats = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(f"c{i}") for i, c in enumerate(categories)]
    src = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"), *cats,
                      (F.col(number) if number in have else F.lit(None)).cast("double").alias("number"))
    id_type = src.schema["k_id"].dataType.simpleString()
    n_cats = len(categories)

    def run(batches):
        buckets: dict[bytes, int] = {}
        for b in batches:
            t = [text_view(v.as_py(), buckets) for v in b.column("text")]
            columns = [b.column(f"c{i}").to_pylist() for i in range(n_cats)]
            m = [meta_view([c[r] for c in columns], x) for r, x in enumerate(b.column("number").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("k_id"), b.column("k_text"), pa.array(t, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.float32()))],
                names=["k_id", "k_text", "text_view", "meta_view"])

    return src.mapInArrow(run, f"k_id {id_type}, k_text bigint, text_view array<float>, meta_view array<float>")


class Logistic:
    """L2-regularised logistic model on standardised features (Newton)."""

    def __init__(self, l2: float = 1.0):
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 30) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._with_one(x)
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.l2)
        ridge[-1] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._with_one(np.asarray(x, np.float64)) @ self.w, -30, 30)


def _matrix(column) -> np.ndarray:
    return np.vstack([np.asarray(v, np.float64) for v in column])


def _scorer(model: Logistic):
    @F.pandas_udf("double")
    def logit(view: pd.Series) -> pd.Series:
        return pd.Series(model.logit(_matrix(view)) if len(view) else np.zeros(0))
    return logit


def drawn(rows: DataFrame, most: int, count: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of the key: a share that follows
    from the count is taken where the rows lie, so what is sent on has the same
    bound at every size of the table. Repeated keys count once."""
    share = 1.0 if count <= most else 1.2 * most / count + 10 / count
    taken = rows.filter(F.pmod(F.xxhash64(F.lit("draw"), "k_id", "k_text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return taken.dropDuplicates(["k_id", "k_text"]).limit(most)


def sure_from(logit: np.ndarray, y: np.ndarray, good: float, confidence: float, least: int = 5) -> float | None:
    """The lowest score (for class 0, of its negative) from which on held-out
    rows are of the class with the wanted precision, which must also halve the
    error of always saying so; None where no score is."""
    side = logit if good else -logit
    order = np.argsort(-side, kind="stable")
    right = np.cumsum(y[order] == good) / np.arange(1, len(y) + 1)
    wanted = max(confidence, 1 - 0.5 * (1 - float((y == good).mean())))
    ends = np.flatnonzero(np.append(np.diff(side[order]) != 0, True))  # rows of one score go together
    ends = ends[(ends + 1 >= least) & (right[ends] >= wanted)]
    return float(max(side[order][ends[-1]], 0.0)) if len(ends) else None


def log_loss(model: Logistic, x: np.ndarray, y: np.ndarray) -> float:
    logit = model.logit(x)
    return float(np.logaddexp(0, np.where(y > 0, -logit, logit)).mean())


def co_training(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", categories: tuple[str, ...] = ("lang", "source"), number: str = "n_chars",
                max_labelled: int = 20_000, rounds: int = 3, per_round: int = 500, confidence: float = 0.95,
                threshold: float = 0.5) -> DataFrame:
    """One row per document: k_id, k_text, text_score, meta_score, score, kept."""
    feats = stored(view_features(docs, id_col, text_col, list(categories), number), "views")
    known = (labels.select(F.col(id_col).alias("k_id"), F.col(label_col).cast("double").alias("y"))
             .filter("k_id is not null and y is not null").groupBy("k_id").agg(F.max("y").alias("y")))
    labelled = feats.join(known, "k_id").select("k_id", "k_text", "text_view", "meta_view", "y")
    sample = drawn(labelled, max_labelled, labelled.count()).orderBy(F.xxhash64("k_id", "k_text"), "k_id").toPandas()
    classes = set(sample["y"])
    if len(classes) < 2:
        only = F.lit(float(classes.pop()) if classes else 0.5)
        return feats.select("k_id", "k_text", only.alias("text_score"), only.alias("meta_score"), only.alias("score"),
                            (only >= threshold).alias("kept"))
    views = ("text_view", "meta_view")
    held = np.arange(len(sample)) % 10 >= 7
    if len(set(sample["y"][~held])) < 2 or len(set(sample["y"][held])) < 2:
        held[:] = False
    x = {v: _matrix(sample[v]) for v in views}
    y = sample["y"].to_numpy()
    at = held if held.any() else ~held
    train = {v: [(x[v][~held], y[~held])] for v in views}
    open_docs = feats.join(known.select("k_id"), "k_id", "left_anti")

    def fitted(sets: dict) -> dict:
        return {v: Logistic().fit(np.concatenate([a for a, _ in sets[v]]), np.concatenate([b for _, b in sets[v]])) for v in views}

    models = fitted(train)
    for turn in range(rounds if held.any() else 0):
        sure = {(v, good): sure_from(models[v].logit(x[v][at]), y[at], good, confidence) for v in views for good in (1.0, 0.0)}
        sure = {k: limit for k, limit in sure.items() if limit is not None}
        if not sure:
            break
        scored = stored(open_docs.select("k_id", "k_text", *views, *[_scorer(models[v])(v).alias(f"l_{v}") for v in views]), "scores")
        fits = {(v, good): F.col(f"l_{v}") >= limit if good else F.col(f"l_{v}") <= -limit for (v, good), limit in sure.items()}
        counts = scored.agg(*[F.sum(c.cast("long")).alias(f"{v}{good}") for (v, good), c in fits.items()]).first()
        picks = None
        for (v, good), fit in fits.items():
            other = views[1 - views.index(v)]
            # as many of a class as it has among the labels
            want = max(1, round((turn + 1) * per_round * float((y == good).mean())))
            best = drawn(scored.filter(fit), want, counts[f"{v}{good}"] or 0).select(
                F.col(other).alias("x"), F.lit(other).alias("to"), F.lit(good).alias("y"))
            picks = best if picks is None else picks.unionByName(best)
        got = picks.toPandas()  # at most 2 * rounds * per_round rows
        more = {v: train[v][:1] + ([(_matrix(own["x"]), own["y"].to_numpy())] if len(own := got[got["to"] == v]) else []) for v in views}
        new = fitted(more)
        # a view takes the labels only if it judges the held-out rows no worse
        better = {v: log_loss(new[v], x[v][at], y[at]) <= log_loss(models[v], x[v][at], y[at]) for v in views}
        if not any(better.values()):
            break
        models = {v: new[v] if better[v] else models[v] for v in views}
        train = {v: more[v] if better[v] else train[v] for v in views}
    prior = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    platt = {v: Logistic(l2=1e-2).fit(models[v].logit(x[v][at])[:, None], y[at]) for v in views}

    @F.pandas_udf("text_score double, meta_score double, score double")
    def final(text: pd.Series, meta: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"text_score": [], "meta_score": [], "score": []}, dtype="float64")
        lt, lm = (platt[v].logit(models[v].logit(_matrix(c))[:, None]) for v, c in zip(views, (text, meta)))
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pd.DataFrame({"text_score": p(lt), "meta_score": p(lm), "score": p(lt + lm - prior)})

    return (feats.select("k_id", "k_text", final("text_view", "meta_view").alias("s"))
            .select("k_id", "k_text", "s.*", (F.col("s.score") >= threshold).alias("kept")))


def filter_by_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier keeps, all columns unchanged."""
    return keep_rows(docs, co_training(docs, labels, id_col, text_col).filter("kept"), id_col, text_col)
