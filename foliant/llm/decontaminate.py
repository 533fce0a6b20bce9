"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton over the items' words is built once and sent to the tasks; a document's
words run through it, and the length of the longest match that ends at each word tells
which windows occur: a match of ``window`` words or more ends one there, and so does a
match that holds a whole shorter item.  Words outside the items' vocabulary reset the
match, so only runs of known words as long as the shortest window are followed at all.

Items are packed into automata of at most ``BLOCK_WORDS`` words (longer ones in parts that
share window - 1 words), so what is broadcast stays bounded.  One automaton is met in the
pass that judges; of a larger benchmark, texts are streamed against one automaton after
another, and only what is hit is written and joined to the texts at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import few_rows, ship, utf8
from foliant.tables import Scratch

BLOCK_WORDS = 200_000
_DIGITS_LETTERS = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z; every other ASCII character that is no letter or digit separates words.
_FOLD = bytes(c if c >= 128 or c in _DIGITS_LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton; answers which windows of which items end at a word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13) -> None:
        self.window = window
        # Items with equal words are one class: they cost as one.
        classes: dict[tuple[bytes, ...], set[str]] = {}
        for name, words in items:
            if words:
                classes.setdefault(tuple(words), set()).add(name)
        self.names = list(classes.values())
        texts = list(classes)
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        #: By state, the short items it holds whole: (words, item).
        short: dict[int, set[tuple[int, int]]] = {}
        self.shortest = min((min(len(t), window) for t in texts), default=window)
        for k, words in enumerate(texts):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), ends)
                ends[last].add(k)
            if len(words) < window:
                # Found once all items are in: later extensions may split the state.
                short.setdefault(-1, set()).add((len(words), k))
        # Items by the shortest state of window words or more: as many as there are windows at most.
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.length[self.link[v]] >= window:
                ends[self.link[v]] |= ends[v]
                ends[v] = set()
        self.items = {v: frozenset(e) for v, e in enumerate(ends) if e and self.length[v] >= window}
        for n, k in short.pop(-1, ()):
            v = 0
            for w in texts[k]:
                v = self.next[v][self.vocabulary[w]]
            short.setdefault(v, set()).add((n, k))
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=lambda v: self.length[v]):
            self.whole[v] = (*self.whole[self.link[v]], *short.get(v, ()))

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        def new(length: int, link: int, edges: dict[int, int]) -> int:
            self.next.append(edges)
            self.link.append(link)
            self.length.append(length)
            ends.append(set())
            return len(self.length) - 1

        def split(p: int, q: int) -> int:
            clone = new(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = clone
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = clone
                p = self.link[p]
            return clone

        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        state, p = new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return state

    def follow(self, ids: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Marks in ``hit`` (from ``at``) the words of windows among ``ids``; adds classes of items to ``found``."""
        state = matched = 0
        met: set[int] = set()
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            if matched >= self.window:
                v = state
                while self.length[self.link[v]] >= self.window:
                    v = self.link[v]
                met.add(v)
                hit[at + i + 1 - self.window : at + i + 1] = True
            # Whole short items that end here have different lengths: fewer than a window has words.
            for n, k in self.whole[state]:
                if n <= matched:
                    found.add(k)
                    hit[at + i + 1 - n : at + i + 1] = True
        for v in met:
            found |= self.items.get(v, frozenset())

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: no word), and the names of the items with occurring windows."""
        if len(words) < self.shortest or not self.names:
            return None, set()
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate([[False], ids >= 0, [False]])
        starts, stops = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
        hit, found = np.zeros(len(words), bool), set()
        for k in np.flatnonzero(stops - starts >= self.shortest):
            self.follow(ids[starts[k] : stops[k]].tolist(), hit, int(starts[k]), found)
        return (hit, set().union(*[self.names[k] for k in found])) if found else (None, set())


def automata(benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of blocks of the benchmark; items with equal words lie in one block, where they count as one and a word each for their names."""
    block, size = [], 0
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("i"), utf8(benchmark["text"]).alias("t")).where("i is not null").distinct()
    words = F.trim(F.regexp_replace(F.lower(F.col("t").cast("string")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    step = max(block_words, window) - window + 1
    last: list[bytes] = []
    for r in rows.withColumn("_k", F.xxhash64(words)).orderBy("_k", "i").drop("_k").toLocalIterator():
        own = item_words(bytes(r["t"]))
        again, last = own == last, own
        for lo in range(0, max(1, len(own) - window + 1), step):
            part = own[lo : lo + step + window - 1]
            cost = 1 if again else len(part)
            if size and size + cost > block_words:
                yield Automaton(block, window)
                block, size, cost = [], 0, len(part)
            block.append((r["i"], part))
            size += cost
    if block:
        yield Automaton(block, window)


def without_spans(text: bytes, hit: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Byte spans of the runs of hit words, and the text without them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD).translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")))]
    spans: list[tuple[int, int]] = []
    for k in np.flatnonzero(hit):
        lo, hi = at[k]
        if spans and k and hit[k - 1]:
            spans[-1] = (spans[-1][0], hi)
        else:
            spans.append((lo, hi))
    out, last = [], 0
    for lo, hi in spans:
        out.append(text[last:lo])
        last = hi
    return spans, b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: tuple[int, int] = (1, 20), block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs`` and a struct ``decontamination`` for every row.

    Its fields: n_words, n_hit, n_items, items_sha256, contaminated (some word is hit and
    the hit words' share is at least ``share``), spans (byte offsets of hit runs) and clean
    (the text without them; null where nothing is hit).  Null text has no words; items
    without words have no window; items with equal words each count, and cost as one; an empty benchmark
    hits nothing.  Null and repeated ids are rows like others.  A column of ``docs`` named
    ``decontamination`` is replaced; names of other columns don't matter.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = T.StructType.fromDDL(
        "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,stop:long>>, clean string"
    )
    fields = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("clean", pa.string())])
    own = docs.drop("decontamination")
    final = T.StructType([*own.schema.fields, T.StructField("decontamination", kind)])
    width, place = len(own.columns), [f.name for f in own.schema.fields].index("text")

    def judged(text: bytes | None, hit: np.ndarray | None, names: set[str]) -> dict:
        words = len(item_words(text)) if hit is None else len(hit)
        spans, clean = without_spans(text, hit) if hit is not None else ([], None)
        n_hit = int(hit.sum()) if hit is not None else 0
        return {
            "n_words": words, "n_hit": n_hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
            "contaminated": n_hit > 0 and share[1] * n_hit >= share[0] * words, "spans": [{"start": a, "stop": z} for a, z in spans],
            "clean": None if clean is None else clean.decode("utf-8", "replace"),
        }

    def at_once(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in few_rows(batches):
                rows = []
                for t in b.column(place).cast(pa.binary()).to_pylist():
                    rows.append(judged(t, *(shared.value.scan(item_words(t)) if shared else (None, set()))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, fields)], names=final.names)

        return run

    def stream(shared):
        """(key, hit, items) of the texts that an automaton hits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in few_rows(batches):
                rows = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    hit, names = shared.value.scan(item_words(t))
                    if hit is not None:
                        rows.append((k, np.packbits(hit).tobytes(), sorted(names)))
                keys, hits, items = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["key", "hit", "items"])

        return run

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = []
            for t, found in zip(b.column(place).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                n = len(item_words(t))
                masks = [np.unpackbits(np.frombuffer(x["hit"], np.uint8), count=n).astype(bool) for x in found or ()]
                rows.append(judged(t, np.logical_or.reduce(masks) if masks else None, {i for x in found or () for i in x["items"]}))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(rows, fields)], names=final.names)

    scratch, kept, last = None, None, None
    for automaton in automata(benchmark, window, block_words):
        if last is not None:
            scratch = scratch or Scratch(spark, "decontamination")
            hits = _hits(own, stream, spark.sparkContext.broadcast(last), scratch)
            kept = hits if kept is None else kept.unionAll(hits)
        last = automaton
    shared = None if last is None else spark.sparkContext.broadcast(last)
    if kept is None:
        return own.mapInArrow(at_once(shared), final)
    kept = kept.unionAll(_hits(own, stream, shared, scratch))
    # A text has a row an automaton at most; columns are told by their place, so no name can clash.
    found = scratch.keep(kept.groupBy("key").agg(F.collect_list(F.struct("hit", "items")).alias("found")))
    scratch.leave(found)
    named = own.toDF(*[f"c{i}" for i in range(len(own.columns))])
    joined = named.withColumn("key", F.unhex(F.sha2(utf8(f"c{place}"), 256))).join(found, "key", "left").drop("key")
    return joined.mapInArrow(gathered, final)


def _hits(own: DataFrame, stream, shared, scratch: Scratch) -> DataFrame:
    """Texts are known by their hash, so that rows of equal texts are scanned alike and written once."""
    text = own.select(utf8(own["text"]).alias("t"))
    return scratch.keep(text.select(F.unhex(F.sha2("t", 256)).alias("key"), "t").mapInArrow(stream(shared), "key binary, hit binary, items array<string>").dropDuplicates(["key"]))
