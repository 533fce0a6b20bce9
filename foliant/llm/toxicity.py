"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word's embedding is the sum of three rows: two picked by 16 bits each of the word's hash,
so that words share both only if both collide, and one by its first letters, so that forms
of a word that training never met are known by their stem.  Filters of several
widths run over the whole text, each is max-pooled, and a logistic layer reads the pools.
Only the winning positions pass gradients on, so a step costs little however long texts are.

All labelled rows are learned from: they are dealt into blocks of bounded size by hash.  The
first block is fitted alone; then, in each round, every block goes on from the shared weights
in a task of its own, and each weight moves by the mean change of the blocks that moved it.
Changes are summed as whole numbers, so the result depends neither on partitions nor on order.

For scoring, every filter's weights are multiplied into the embedding rows beforehand: a
convolution is then a sum of looked-up rows.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, learns, ship, utf8, word_hash
from foliant.llm.labelled import labelled_rows
from foliant.tables import Scratch, one_use_shuffles

SLOTS, PARTS, STEM = 1 << 16, 3, 4
_KEEP = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Lower-cases ASCII letters and turns other ASCII characters into blanks.
_FOLD = bytes(c if c >= 128 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words held at once while scoring.
SLICE = 30_000
#: Words whose rows are remembered, and the longest of them in bytes.
WORDS, LONG = 60_000, 64
#: Rows and bytes of words in a block, about; rounds over all blocks; one row in so many only calibrates.
BLOCK_ROWS, BLOCK_BYTES, ROUNDS, FOLDS = 4000, 32 << 20, 2, 5
#: Changes of weights are summed in units of this part of one.
UNIT = float(1 << 40)
CUTS = np.round(np.arange(0.30, 0.951, 0.05), 2)


class _Rows(dict):
    """A word's rows, 16 bits each; all are forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        h, stem = word_hash(word), word_hash(word[:STEM])
        rows = (h & 0xFFFFFFFF) | (stem >> 32 & 0xFFFF) << 32
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= LONG:
            self[word] = rows
        return rows


_ROWS = _Rows()


def word_slots(text: bytes) -> np.ndarray:
    """(words, PARTS): rows of the parts of the embedding."""
    words = text.translate(_FOLD).split()
    packed = np.fromiter(map(_ROWS.__getitem__, words), dtype="<u8", count=len(words))
    return np.ascontiguousarray(packed.view("<u2").reshape(-1, 4)[:, :PARTS])


@dataclass
class Cnn:
    embedding: np.ndarray  # (PARTS, SLOTS, dim)
    filters: dict[int, np.ndarray]  # width -> (width, dim, maps)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Sums of squared gradients, as ``weights`` lists the weights; none before a fit.
    seen: list[np.ndarray] = field(default_factory=list)
    _tables: dict[int, np.ndarray] | None = field(default=None, repr=False)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.out, *self.filters.values(), *self.bias.values()]

    def tables(self) -> dict[int, np.ndarray]:
        """width -> (width, PARTS, SLOTS, maps): embedding rows times the weights at each offset."""
        return {w: np.einsum("hsd,odm->ohsm", self.embedding, f).astype(np.float32) for w, f in self.filters.items()}

    def kept_tables(self) -> dict[int, np.ndarray]:
        """The same, made once a process: workers make them, so that the driver neither holds nor sends them."""
        if self._tables is None:
            self._tables = self.tables()
        return self._tables


def _pad(slots: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``widest`` positions, and which of them hold words."""
    n = max(len(slots), widest)
    if n == len(slots):
        return slots, np.ones(n, bool)
    out, real = np.zeros((n, PARTS), np.uint16), np.zeros(n, bool)
    out[: len(slots)], real[: len(slots)] = slots, True
    return out, real


def pooled(tables: dict[int, np.ndarray], bias: dict[int, np.ndarray], slots: np.ndarray) -> np.ndarray:
    """Max-pooled activations over the whole text, in slices that overlap by the widest filter."""
    widest, best = max(tables), None
    slots, real = _pad(slots, widest)
    for lo in range(0, max(1, len(slots) - widest + 1), SLICE):
        s, m = slots[lo : lo + SLICE + widest - 1], real[lo : lo + SLICE + widest - 1, None]
        got = []
        for w, t in tables.items():
            n = len(s) - w + 1
            total = np.broadcast_to(bias[w], (n, len(bias[w]))).copy()
            for o in range(w):
                total += sum(t[o, p][s[o : o + n, p]] for p in range(PARTS)) * m[o : o + n]
            got.append(total.max(axis=0))
        got = np.concatenate(got)
        best = got if best is None else np.maximum(best, got)
    return np.maximum(best, 0)


def new_cnn(rng: np.random.Generator, dim: int = 8, maps: int = 6, widths: tuple[int, ...] = (1, 2, 3)) -> Cnn:
    return Cnn(rng.normal(0, 0.05, (PARTS, SLOTS, dim)).astype(np.float32), {w: rng.normal(0, 0.4, (w, dim, maps)).astype(np.float32) for w in widths}, {w: np.zeros(maps) for w in widths}, rng.normal(0, 0.3, maps * len(widths)), 0.0)


def _groups(at: np.ndarray, padded: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Runs of texts with SLICE words in all, or one longer text."""
    place = np.cumsum([len(padded[i][0]) for i in at]) // SLICE
    yield from np.split(at, np.flatnonzero(np.diff(place)) + 1)


def fit_cnn(
    texts: list[np.ndarray], y: np.ndarray, dim: int = 8, maps: int = 6, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 6, batch: int = 24, rate: float = 0.08, seed: int = 7,
    start: Cnn | None = None, share: float | None = None,
) -> Cnn:
    """AdaGrad on the log loss with balanced classes, from ``start``; ``share`` is that of label 1 among all rows.

    Without ``share`` these are all rows, and one class only gives a constant model.
    """
    rng = np.random.default_rng(seed)
    net = copy.deepcopy(start) if start else new_cnn(rng, dim, maps, widths)
    p = (y.sum() + 0.5) / (len(y) + 1) if share is None else share
    if share is None and len(set(y.tolist())) < 2:
        net.out[:] = 0
        net.out_bias = float(np.log(p / (1 - p)))
        return net
    weight = np.where(y == 1, 0.5 / max(p, 1e-3), 0.5 / max(1 - p, 1e-3))
    net.seen = net.seen or [*[np.full(a.shape, 1e-4, a.dtype) for a in net.weights()], np.full(1, 1e-4)]
    seen = {id(a): acc for a, acc in zip(net.weights(), net.seen, strict=False)}
    bias_seen, widths, maps = net.seen[-1], list(net.filters), len(next(iter(net.bias.values())))

    def move(a: np.ndarray, g: np.ndarray, at=...) -> None:
        acc = seen[id(a)]
        acc[at] += g * g
        a[at] -= rate * g / np.sqrt(acc[at])

    padded = [_pad(t, max(widths)) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            rows: list[np.ndarray] = []
            grads: list[np.ndarray] = []
            g_out, g_bias = np.zeros_like(net.out), 0.0
            g_f, g_b = {w: np.zeros_like(f) for w, f in net.filters.items()}, {w: np.zeros(maps) for w in widths}
            # All filters at all offsets in one product; (maps, width, dim) for the way back.
            wide = np.concatenate([f.transpose(0, 2, 1).reshape(-1, f.shape[1]) for f in net.filters.values()])
            turned = {w: f.transpose(2, 0, 1) for w, f in net.filters.items()}
            for own in _groups(order[k : k + batch], padded):
                s, real = (np.concatenate([padded[i][j] for i in own]) for j in (0, 1))
                ends = np.cumsum([len(padded[i][0]) for i in own])
                starts, places = np.concatenate([[0], ends[:-1]]), np.arange(len(s))
                e = sum(net.embedding[p, s[:, p]] for p in range(PARTS)) * real[:, None]
                z, tops, where, c = wide @ e.T, [], [], 0
                for w in widths:
                    a = z[c : c + maps]
                    for o in range(1, w):
                        a[:, : len(s) - o] += z[c + o * maps : c + (o + 1) * maps, o:]
                        a[:, ends - o] = -np.inf
                    c += w * maps
                    best = np.maximum.reduceat(a, starts, axis=1)
                    first = np.where(a == np.repeat(best, ends - starts, axis=1), places, len(s))
                    where.append(np.minimum.reduceat(first, starts, axis=1))
                    tops.append(best + net.bias[w][:, None])
                top = np.concatenate(tops)
                pool = np.maximum(top, 0)
                d = (1 / (1 + np.exp(-np.clip(net.out @ pool + net.out_bias, -30, 30))) - y[own]) * weight[own]
                g_out += pool @ d
                g_bias += d.sum()
                back = d * net.out[:, None] * (top > 0)
                for q, w in enumerate(widths):
                    part = back[q * maps : (q + 1) * maps]
                    g_b[w] += part.sum(axis=1)
                    at = where[q][:, :, None] + np.arange(w)
                    g_f[w] += np.einsum("mb,mbwd->wdm", part, e[at])
                    on = (part != 0)[:, :, None] & real[at]
                    rows.append(s[at[on]])
                    grads.append((turned[w][:, None] * part[:, :, None, None])[on])
            size = len(order[k : k + batch])
            move(net.out, g_out / size)
            g_bias /= size
            bias_seen += g_bias**2
            net.out_bias -= float(rate * g_bias / np.sqrt(bias_seen[0]))
            for w in widths:
                move(net.filters[w], g_f[w] / size)
                move(net.bias[w], g_b[w] / size)
            r, g = np.concatenate(rows), np.concatenate(grads) / size
            for half in range(PARTS):
                u, inv = np.unique(r[:, half], return_inverse=True)
                total = np.zeros((len(u), g.shape[1]), np.float32)
                np.add.at(total, inv, g)
                move(net.embedding, total, (half, u))
    return net


def cnn_scores(net: Cnn, texts: list[np.ndarray], tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
    tables = tables or net.tables()
    bias = {w: b.astype(np.float32) for w, b in net.bias.items()}
    pools = np.array([pooled(tables, bias, t) for t in texts], dtype=np.float64).reshape(len(texts), len(net.out))
    return 1 / (1 + np.exp(-np.clip(pools @ net.out + net.out_bias, -30, 30)))


def calibrate(counts: dict[str, np.ndarray], default: float) -> dict[str, float]:
    """By language the threshold of the best F1, nearest to ``default`` in a tie.

    ``counts`` has by language the rows of each label (0, 1) that reach so many of CUTS.
    """
    out = {}
    for lang, n in sorted(counts.items()):
        if n.sum() < 20 or not n.sum(axis=1).all():
            continue
        # Rows of both labels that reach each cut.
        over = n[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        f1 = 2 * over[1] / (over.sum(axis=0) + n[1].sum())
        out[lang] = float(min((c for c, f in zip(CUTS, f1, strict=True) if f == f1.max()), key=lambda c: (abs(c - default), c)))
    return out


def _words(x: pa.ChunkedArray) -> list[np.ndarray]:
    """(words, PARTS) of each row, where the column has them."""
    out: list[np.ndarray] = []
    for c in x.cast(pa.binary()).chunks:
        if len(c):
            _, offsets, data = c.buffers()
            at = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1]
            flat = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(-1, PARTS)
            out += np.split(flat, (at[1:-1] - at[0]) // (2 * PARTS))
    return out


def _block(t: pa.Table, held: bool = False) -> tuple[list[np.ndarray], np.ndarray, list[str | None]]:
    """Words, labels and languages of a block's rows, by id: of those that only calibrate, or of the others.

    Words stay where the block has them; only rows of the same id are told apart by theirs.
    """
    ids = t.column("doc_id").to_numpy()
    at = np.argsort(ids, kind="stable")
    for run in np.split(at, np.flatnonzero(np.diff(ids[at])) + 1):
        if len(run) > 1:
            again = t.take(pa.array(run)).append_column("at", pa.array(run))
            run[:] = again.sort_by([("x", "ascending"), ("lang", "ascending")]).column("at").to_numpy()
    at = at[(np.arange(len(at)) % FOLDS == FOLDS - 1) == held]
    every, t = _words(t.column("x")), t.drop_columns("x").take(pa.array(at))
    return [every[i] for i in at.tolist()], t.column("y").to_numpy().astype(np.float64), t.column("lang").to_pylist()


def _dense(net: Cnn) -> np.ndarray:
    """All weights but the embedding, in rows as long as the embedding's."""
    dim, flat = net.embedding.shape[2], np.concatenate([*[a.reshape(-1) for a in net.weights()[1:]], [net.out_bias]]).astype(np.float64)
    return np.pad(flat, (0, -len(flat) % dim)).reshape(-1, dim)


def changes(before: Cnn, after: Cnn) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights that differ, and by how much in whole units; those beside the embedding follow it."""
    dim = before.embedding.shape[2]
    by = after.embedding.reshape(-1, dim).astype(np.float64) - before.embedding.reshape(-1, dim)
    at, rest = np.flatnonzero(by.any(axis=1)), _dense(after) - _dense(before)
    return np.concatenate([at, len(by) + np.arange(len(rest))]), np.rint(np.concatenate([by[at], rest]) * UNIT).astype(np.int64)


def moved(net: Cnn, at: np.ndarray, by: np.ndarray) -> Cnn:
    """``net`` with ``by`` added to the rows ``at``, as ``changes`` numbers them."""
    net = copy.deepcopy(net)
    dim = net.embedding.shape[2]
    own = at < PARTS * SLOTS
    flat = net.embedding.reshape(-1, dim)
    flat[at[own]] += by[own]
    dense = _dense(net)
    dense[at[~own] - PARTS * SLOTS] += by[~own]
    dense, k = dense.reshape(-1), 0
    for a in net.weights()[1:]:
        a[...] = dense[k : k + a.size].reshape(a.shape)
        k += a.size
    net.out_bias = float(dense[k])
    return net


def _first_fit(rows: DataFrame, share: float | None) -> Cnn:
    def run(t: pa.Table) -> pa.Table:
        texts, y, _ = _block(t)
        return pa.table({"net": pa.array([pickle.dumps(fit_cnn(texts, y, share=share))], pa.binary())})

    # As a column: a row of Python objects would be copied over and over on the driver.
    got = rows.groupBy("block").applyInArrow(run, "net binary").toArrow().column("net")
    return pickle.loads(got[0].as_buffer()) if len(got) else new_cnn(np.random.default_rng(7))


def _round(rows: DataFrame, net: Cnn, share: float, k: int) -> Cnn:
    """One epoch of every block from ``net``; the mean change of each row of weights that some block moved."""
    sc, dim = rows.sparkSession.sparkContext, net.embedding.shape[2]
    shared = sc.broadcast(net)

    def run(t: pa.Table) -> pa.Table:
        texts, y, _ = _block(t)
        at, by = changes(shared.value, fit_cnn(texts, y, epochs=1, seed=k, start=shared.value, share=share))
        return pa.table({"at": pa.array(at, pa.int64())} | {f"v{j}": pa.array(by[:, j]) for j in range(dim)})

    each = rows.groupBy("block").applyInArrow(run, "at long, " + ", ".join(f"v{j} long" for j in range(dim)))
    sums = each.groupBy("at").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(dim)]).toArrow()
    shared.destroy()
    by = np.stack([sums.column(f"v{j}").to_numpy() for j in range(dim)], axis=1) / sums.column("n").to_numpy()[:, None] / UNIT
    return moved(net, sums.column("at").to_numpy(), by)


def _thresholds(rows: DataFrame, net: Cnn, default: float) -> dict[str, float]:
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(net)

    def run(t: pa.Table) -> pa.Table:
        texts, y, langs = _block(t, held=True)
        reached = (cnn_scores(shared.value, texts, shared.value.kept_tables())[:, None] >= CUTS).sum(axis=1)
        return pa.table({"lang": pa.array(langs, pa.string()), "y": pa.array(y.astype(np.int32)), "reached": pa.array(reached.astype(np.int32))})

    scored = rows.groupBy("block").applyInArrow(run, "lang string, y int, reached int").where("lang is not null")
    counts: dict[str, np.ndarray] = {}
    for r in scored.groupBy("lang", "y", "reached").count().collect():
        counts.setdefault(r["lang"], np.zeros((2, len(CUTS) + 1), np.int64))[r["y"], r["reached"]] = r["count"]
    shared.destroy()
    return calibrate(counts, default)


def fit_toxicity(docs: DataFrame, labels: DataFrame, default: float = 0.7, block_rows: int = BLOCK_ROWS) -> Cnn:
    """Fits on all labelled documents outside the held-out fold; every FOLDS-th row of a block only calibrates."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    known = scratch.keep(labelled_rows(docs, labels, "toxic", lambda texts: [word_slots(t).tobytes() for t in texts]))
    n, ones, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()
    blocks, share = max(1, -(-n // block_rows), -(-size // BLOCK_BYTES)), (ones + 0.5) / (n + 1)
    rows = known.withColumn("block", F.pmod(F.xxhash64("doc_id", "x"), F.lit(blocks)))
    with one_use_shuffles(spark):
        if 0 < ones < n:
            net = _first_fit(rows.where("block = 0"), share if blocks > 1 else None)
            for k in range(ROUNDS if blocks > 1 else 0):
                net = _round(rows, net, share, k)
        else:
            net = fit_cnn([], np.array([]))
            net.out_bias = float(np.log(share / (1 - share)))
        net.seen = []
        net.thresholds = _thresholds(rows, net, default)
    scratch.leave()
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, default: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, rejected for every row of ``docs``.

    ``predicted`` cuts at ``default``; ``rejected`` at the threshold of the row's language
    (``default`` where the language had too few rows).  Null text is scored as the empty
    one; repeated rows each get a row; a row without an id is scored, with a null
    ``held_out``.  A very long text is pooled whole, over all of its words.  Without labels of
    both classes the score is constant; an empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    net = fit_toxicity(docs, labels, default)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value, shared.value.kept_tables()
        for b in few_rows(batches):
            s = cnn_scores(net, [word_slots(t) for t in b.column("_t").to_pylist()], tables)
            cuts = np.array([net.thresholds.get(x, default) for x in b.column("_lang").to_pylist()], dtype=np.float64)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= default).astype(np.int32)), pa.array(cuts), pa.array(s >= cuts)], ["doc_id", "held_out", "score", "predicted", "threshold", "rejected"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (~learns(docs["doc_id"])).alias("held_out"), utf8(docs["text"]).alias("_t"), docs["lang"].cast("string").alias("_lang"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, rejected boolean")
