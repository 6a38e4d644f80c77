"""Document quality by a generalised additive model with pairwise interactions.

Features of the text are counted in the scan's tasks. Training rows, a sample of labelled rows of
bounded size, go to the driver; there shallow trees are boosted on one feature at a time, in
turn, each adding its leaves to that feature's lookup table, and then, in turn again, trees of two
levels on the pairs of features that explain most of what is left. A score is the sum of the tables' entries at a text's bins,
added for a whole batch at once.

Rows: a null text counts as empty and is scored like any other; every row, repeated or with a
null id, gives one row (a null id is never held out); rows of ``labels`` with nulls are unused and
an id labelled twice takes the mean of its labels; where an id repeats in the documents, all its
rows learn its label, up to twice ``sample_rows`` in the order of hashes; without a labelled row every
score is 0.5 and the filter keeps all documents, for it has nothing against them; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import table

THRESHOLD = 0.7
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "upper", "digit", "other_ascii", "wide", "pipe", "exclamation", "comma", "stop",
    "symbols", "word_length", "word_spread", "distinct_words", "repeats", "top_word", "log_lines", "distinct_lines",
    "line_words", "odd_endings", "capital_lines", "long_words",
)
_CLASS = {name: np.zeros(256) for name in ("upper", "digit", "other_ascii", "wide", "pipe", "exclamation", "comma", "stop", "symbols")}
_CLASS["upper"][ord("A") : ord("Z") + 1] = 1
_CLASS["digit"][ord("0") : ord("9") + 1] = 1
_CLASS["wide"][128:] = 1
for _name, _chars in (("pipe", "|"), ("exclamation", "!"), ("comma", ","), ("stop", "."), ("symbols", "#$%&*@^~_=+<>{}[]\\/")):
    _CLASS[_name][[ord(c) for c in _chars]] = 1
_CLASS["other_ascii"][33:127] = 1
_CLASS["other_ascii"][[*range(48, 58), *range(65, 91), *range(97, 123)]] = 0
_COUNTED = list(_CLASS)
_MATRIX = np.stack([_CLASS[n] for n in _COUNTED])
_ODD = frozenset(b"!%&$*#|")


def features(text: str | None) -> list[float]:
    """The features of a text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    levels = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (_MATRIX @ levels / max(1, len(data))).tolist()
    words = data.split()
    n = len(words)
    lines = [ln for ln in data.split(b"\n") if ln.strip()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    top = max(counts.values(), default=0)
    odd = sum(w[-1] in _ODD for w in words)
    return [
        np.log1p(len(data)), np.log1p(n), *shares,
        float(lengths.mean()), float(lengths.std()), len(counts) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), top / max(1, n),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), odd / max(1, n),
        sum(ln.isupper() for ln in lines) / max(1, len(lines)), float((lengths > 14).mean()),
    ]


def _leaves(grad: np.ndarray, hess: np.ndarray, n_leaves: int, least: float, ridge: float) -> np.ndarray:
    """A piecewise constant fit over ordered bins: the best splits, one after the other."""
    parts = [(0, len(grad))]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    while len(parts) < n_leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gl, hl, gr, hr = g[cut] - g[a], h[cut] - h[a], g[b] - g[cut], h[b] - h[cut]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
            gain[(hl < least) | (hr < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (a, b), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_leaves(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of two levels over a grid of two ordered features: a split of one feature's bins, and on
    each side the best split of the other's."""

    def halves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best split over the last axis of sums over the first: its gain and its leaves."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
        k = int(gain.argmax())
        leaves = np.full(len(g), gr[k] / (hr[k] + ridge))
        leaves[: k + 1] = gl[k] / (hl[k] + ridge)
        return float(gain[k]), leaves

    best, out = -1.0, np.zeros_like(grad)
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        for cut in range(1, len(g)):
            (a, low), (b, high) = halves(g[:cut].sum(axis=0), h[:cut].sum(axis=0)), halves(g[cut:].sum(axis=0), h[cut:].sum(axis=0))
            if a + b > best:
                tree = np.vstack([np.tile(low, (cut, 1)), np.tile(high, (len(g) - cut, 1))])
                best, out = a + b, tree.T if turned else tree
    return out


class AdditiveModel:
    """Lookup tables over the bins of single features and of pairs; plain arrays, small to send."""

    def __init__(self, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1):
        self.bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate = bins, rounds, pair_rounds, pairs, rate
        self.base, self.edges, self.tables = 0.0, [], []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.trained = False

    def _binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.trained = n > 0
        if not self.trained:
            return self
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        at = self._binned(x)
        z = np.full(n, self.base)
        least = max(0.2, 0.0005 * n)

        def state() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for j in range(m):
                size = len(self.tables[j])
                if size < 2:
                    continue
                r, w = state()
                step = self.rate * _leaves(np.bincount(at[j], r, size), np.bincount(at[j], w, size), 3, least * 0.05, 1.0)
                self.tables[j] += step
                z += step[at[j]]
        coarse = [np.minimum(b * 8 // (len(t)), 7) for b, t in zip(at, self.tables)]
        r, w = state()
        gains = {}
        for a in range(m):
            for b in range(a + 1, m):
                cell = coarse[a] * 8 + coarse[b]
                gains[a, b] = float((np.bincount(cell, r, 64) ** 2 / (np.bincount(cell, w, 64) + 5.0)).sum())
        self.pairs = sorted(gains, key=gains.get, reverse=True)[: self.n_pairs]
        self.pair_tables = [np.zeros(64) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for k, (a, b) in enumerate(self.pairs):
                cell = coarse[a] * 8 + coarse[b]
                r, w = state()
                step = self.rate * _pair_leaves(np.bincount(cell, r, 64).reshape(8, 8), np.bincount(cell, w, 64).reshape(8, 8), 5.0).ravel()
                self.pair_tables[k] += step
                z += step[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self._binned(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[at[j]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            ca, cb = (np.minimum(at[i] * 8 // len(self.tables[i]), 7) for i in (a, b))
            z += t[ca * 8 + cb]
        return 1 / (1 + np.exp(-z))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, chosen by their hash."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.avg(label_col).alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)  # the bound of the broadcast, 16 bytes a row
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").select("__id", "__label", "__text", F.xxhash64("__text").alias("__h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "h", "x"])

    made = rows.mapInArrow(run, "id long, label double, h long, x array<double>")
    found = made.orderBy(F.xxhash64("id", "h"), "id", "h").limit(2 * sample_rows).toPandas()
    x = np.array(found["x"].tolist()) if len(found) else np.zeros((0, len(FEATURES)))
    return AdditiveModel().fit(x, found["label"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_matrix(batch.column(1).to_pylist())))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; all of them where
    no row is labelled.

    The score is computed in the row's own task, so the texts are not shuffled.
    """
    learned = fit(docs, labels)
    if not learned.trained:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = model.value.score(_matrix(batch.column("text").to_pylist())) >= threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
