"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; in each step a shallow tree over one
feature's bins is fitted to the gradients and added to that feature's lookup
table.  The strongest pairs of features then get two-dimensional tables by trees
with one cut on either side.  A score is the logistic of an intercept and one
table entry for each feature and pair, so scoring adds up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training reads at most, by a hash of the id.
MAX_LABELLED = 20_000
ROUNDS, PAIR_ROUNDS, PAIRS, BINS, PAIR_BINS = 200, 100, 6, 48, 48
RATE, RIDGE, LEAST_WEIGHT = 0.1, 1.0, 2.0
FEATURES = (
    "log_words", "word_length", "longest_word", "distinct_words", "upper", "digit", "space", "symbol", "bang", "pipe",
    "stop_mark", "comma", "other_ascii", "line_words", "dup_lines", "upper_words",
)
_UPPER, _DIGIT, _LOWER = slice(65, 91), slice(48, 58), slice(97, 123)
_SYMBOLS = list(b"#*$%&<>")


def text_features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``; null and empty texts: all zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    blank = int(seen[32] + seen[9:14].sum())
    chars = size - blank
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, digit, lower = int(seen[_UPPER].sum()), int(seen[_DIGIT].sum()), int(seen[_LOWER].sum())
    symbols, bang, pipe, stop, comma = int(seen[_SYMBOLS].sum()), int(seen[33]), int(seen[124]), int(seen[46]), int(seen[44])
    ascii_rest = int(seen[33:127].sum()) - upper - digit - lower - symbols - bang - pipe - stop - comma
    return [
        float(np.log1p(n)), chars / n, float(max(map(len, words))), len(set(words)) / n, upper / chars, digit / chars, blank / size,
        symbols / n, bang / n, pipe / n, stop / n, comma / n, ascii_rest / n, n / len(lines), 1 - len(set(lines)) / len(lines),
        sum(w[:1].isupper() for w in words) / n,
    ]


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *carry, features)`` with the features of every row as an array; a carried column of either name is left out."""
    carry = tuple(c for c in carry if c not in ("id", "features"))
    rows = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).cast("string").alias("__text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            values = pa.array([text_features(t.as_py()) for t in b.column(len(kept))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], values], names=[*kept, "features"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def _two_cuts(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of depth two over ordered bins with gradient and weight sums g and h."""

    def best(a: int, b: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left, right = hs[:-1], hs[-1] - hs[:-1]
        gain = gs[:-1] ** 2 / (left + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (right + RIDGE) - gs[-1] ** 2 / (hs[-1] + RIDGE)
        gain[(left < LEAST_WEIGHT) | (right < LEAST_WEIGHT)] = -1.0
        k = int(np.argmax(gain)) if len(gain) else 0
        return (float(gain[k]), a + k + 1) if len(gain) and gain[k] > 1e-12 else (0.0, -1)

    cuts = [0, len(g)]
    _, first = best(0, len(g))
    if first > 0:
        cuts.insert(1, first)
        for a, b in ((0, first), (first, len(g))):
            _, more = best(a, b)
            if more > 0:
                cuts.append(more)
    cuts = sorted(set(cuts))
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on either side of a grid: its gain and values."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    g11, h11 = gs[:-1, :-1], hs[:-1, :-1]
    g12, h12 = gs[:-1, -1:] - g11, hs[:-1, -1:] - h11
    g21, h21 = gs[-1:, :-1] - g11, hs[-1:, :-1] - h11
    g22, h22 = gs[-1, -1] - g11 - g12 - g21, hs[-1, -1] - h11 - h12 - h21
    if not g11.size:
        return 0.0, np.zeros_like(g)
    gain = sum(a**2 / (b + RIDGE) for a, b in ((g11, h11), (g12, h12), (g21, h21), (g22, h22)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gain[i, j] - gs[-1, -1] ** 2 / (hs[-1, -1] + RIDGE)), out


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


@dataclass
class Gam:
    """Lookup tables over bins; ``edges`` cut each feature, ``coarse`` cut it for pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "left")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], "left"), np.searchsorted(self.coarse[b], x[:, b], "left")]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of label y (0 or 1) by features x; without rows, or with one label, a constant."""
    n, width = (len(y), x.shape[1]) if len(y) else (0, len(FEATURES))
    rate = (y.sum() + 1.0) / (n + 2.0)
    model = Gam(float(np.log(rate / (1 - rate))))
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(width)]
    model.coarse = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    binned = [np.searchsorted(model.edges[f], x[:, f], "left") for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = gradients()
            size = len(model.tables[f])
            step = RATE * _two_cuts(np.bincount(binned[f], g, size), np.bincount(binned[f], h, size))
            model.tables[f] += step
            total += step[binned[f]]
    wide = [np.searchsorted(model.coarse[f], x[:, f], "left") for f in range(width)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(wide[a] * cols + wide[b], v, rows * cols).reshape(rows, cols)

    g, h = gradients()
    gains = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(width) for b in range(a + 1, width)))
    model.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradients()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[k] += step
            total += step[wide[a], wide[b]]
    return model


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_LABELLED
) -> Gam:
    """Fit on at most ``limit`` labelled rows (chosen by a hash of the id) for which ``usable`` holds.

    ``usable`` is a condition on ``labels``.  Null ids and labels teach nothing;
    an id labelled more than once counts with its smallest label.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.where(usable) if usable is not None else known
    chosen = (
        known.groupBy(id_col)
        .agg(F.min(label_col).cast("int").alias("label"))
        .select(F.col(id_col).alias("id"), "label", F.xxhash64(F.col(id_col)).alias("order"))
        .orderBy("order", "id")
        .limit(limit)
    )
    # at most ``limit`` short rows: their size is proven
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    got = feature_rows(rows, "id", "text", ("label", "order")).collect()
    got.sort(key=lambda r: (r["order"], r["id"], r["features"]))
    x = np.array([r["features"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], float))


def score_texts(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of every row, score from 0 to 1; null and empty texts have one too.

    Repeated rows score alike, an empty table gives an empty result, other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Gam, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``; all columns stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(at)], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
