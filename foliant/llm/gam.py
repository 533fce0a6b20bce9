"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a short vector of surface statistics.  Boosting visits the features
in turn, again and again; each visit fits a tree of at most four leaves to the residual
of one feature and adds it to that feature's lookup table.  The pairs whose 2 x 2 trees
reduce the remaining loss most get tables of their own in a second run.  A score is the
logistic of an intercept and the looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, learns, ship, utf8
from foliant.llm.labelled import labelled_sample

FEATURES = (
    "log_words", "word_bytes", "symbols", "bangs", "upper", "pipes", "digits", "stops", "beyond_ascii",
    "adjacent_repeats", "distinct_words", "distinct_lines", "words_a_line", "capital_words", "longest_word",
)
SYMBOLS, UPPER, DIGITS, STOPS = b"#*$%&<>", bytes(range(65, 91)), b"0123456789", b".,;:?"


def surface(text: bytes) -> list[float]:
    """The statistics named by FEATURES; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    less = lambda chars: (size - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), sum(map(len, words)) / n, less(SYMBOLS), text.count(b"!") / n, less(UPPER), text.count(b"|") / n, less(DIGITS), less(STOPS),
        (size - len(text.decode("utf-8", "replace"))) / size, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, len(set(lines)) / len(lines),
        n / len(lines), sum(map(bytes.istitle, words)) / n, np.log(max(map(len, words))),
    ]


def surfaces(texts: list[bytes]) -> np.ndarray:
    return np.array([surface(t) for t in texts], dtype=np.float32).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float = 0.0
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    pair_bins: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * self.pair_bins // (len(self.edges[j]) + 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse(b, i), self.coarse(b, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g: float | np.ndarray, h: float | np.ndarray, ridge: float = 1.0) -> float | np.ndarray:
    return g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray) -> int:
    """Bin before which a split helps most, 0 for none."""
    if len(g) < 2:
        return 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = lg * _leaf(lg, lh) + (g.sum() - lg) * _leaf(g.sum() - lg, h.sum() - lh) - g.sum() * _leaf(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > 1e-9 else 0


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of depth two."""
    out, first = np.empty(len(g)), _best_cut(g, h)
    for lo, hi in ((0, first), (first, len(g))) if first else ((0, len(g)),):
        second = lo + _best_cut(g[lo:hi], h[lo:hi])
        for a, b in ((lo, second), (second, hi)) if second > lo else ((lo, hi),):
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quad = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gain = sum(a * _leaf(a, b) for a, b in zip(quad(cg), quad(ch), strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for a, b in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[a, b] = _leaf(g[a, b].sum(), h[a, b].sum())
    return float(gain[i, j] - cg[-1, -1] * _leaf(cg[-1, -1], ch[-1, -1])), out


def fit_gam(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, bins: int = 48, rounds: int = 120, rate: float = 0.12, pairs: int = 8) -> Gam:
    """One class only, or no row: a constant model."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.array([]) for j in range(x.shape[1])]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges])
    w = np.ones(len(x)) if weight is None else weight
    p = float((w @ y + 0.5) / (w.sum() + 1))
    model.intercept = float(np.log(p / (1 - p)))
    if len(set(y.tolist())) < 2:
        return model
    b, f = model.bins(x), np.full(len(x), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return w * (y - q), w * q * (1 - q)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = residual()
            step = rate * _shallow_tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            f += step[b[:, j]]
    k = model.pair_bins
    coarse = [model.coarse(b, j) for j in range(x.shape[1])]
    grid = lambda i, j, v: np.bincount(coarse[i] * k + coarse[j], v, k * k).reshape(k, k)
    g, h = residual()
    gains = sorted(((_cross(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((k, k)) for _ in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residual()
            step = rate * _cross(grid(i, j, g), grid(i, j, h))[1]
            t += step
            f += step[coarse[i], coarse[j]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> Gam:
    """Fits on at most ``per_class`` documents a class, weighted back to the classes' sizes."""
    ship(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, "quality", per_class, lambda texts: [v.tobytes() for v in surfaces(texts)])
    x = np.array([np.frombuffer(r[0], np.float32) for r in sample], dtype=np.float32).reshape(len(sample), len(FEATURES))
    y = np.array([r[1] for r in sample], dtype=np.float64)
    got = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, sizes.get(1, 0) / got[1], sizes.get(0, 0) / got[0])
    return fit_gam(x, y, weight / weight.mean() if len(y) else None)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null text is scored as the empty one; repeated rows each get a row; a row without an id
    is scored, with a null ``held_out``.  A very long text is read whole, as counts of its
    bytes and words.  Equal features give equal scores, so ties stay ties.  Without labels of
    both classes every score is the smoothed share of good ones (0.5 without any); an empty
    table gives an empty result; other columns are ignored.
    """
    model = fit_quality(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            s = model.score(surfaces(b.column("_t").to_pylist()))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (~learns(docs["doc_id"])).alias("held_out"), utf8(docs["text"]).alias("_t"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
