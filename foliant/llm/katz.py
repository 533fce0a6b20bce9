"""Katz backoff bigram model: counted, discounted, normalised and evaluated in partitioned blobs.

A token's probability is  d(c) c(h,w) / c(h)  if the bigram (h, w) was met in training,
else  a(h) p(w)  with the history's backoff weight, and p(w) alone after an unknown
history; p(w) is itself the discounted share of the word, or the mass left for unknown
words.  Discounts are Good-Turing's up to a count of K.  (Above K, Katz trusts the
counts; here they give up TRUST of an occurrence, so that every history keeps some mass.)
a(h) = sum (1 - d) c / c(h)  over  1 - sum p(w),  both over the words met after h.

Three tables are dealt by hash, as a few packed rows each rather than a row a token:

* bigrams by their *word*: so the counts of words fall out of the same table;
* histories by their hash: what (1 - d) c and p(w) sum to after each;
* documents by block, a run of documents that one task reads.

The log probability of a text is a sum, so nothing needs to come back to its tokens: the
bigram table adds log d c(h,w) or log p(w) for each token, and -log c(w) for each word as
the history of the next; the history table adds log c(h) a(h) where a bigram was unknown.
Each adds sums for the documents of a block that it has something of, and the last step adds
those up.

Counts are combined per block before any shuffle.  Words that are frequent in a sample
are dealt by word and history, so no word makes a hot partition; the sample decides only
where they go.  Histories are known by 48 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import chunked, few_rows, learns, lower_words, ship, utf8, word_hash
from foliant.tables import Scratch, one_use_shuffles

K, TRUST = 5, 1e-3
START, END = np.uint64(0x51A2B3C4D5E6F708), np.uint64(0xE0D9C8B7A6958473)
BLOCK_TOKENS = 1_200_000
BUCKET_BYTES = 8 << 20
LOW48 = np.uint64((1 << 48) - 1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


# --- blobs: columns as byte planes, whose mostly equal high bytes compress to nothing


def dump(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.char))]], np.int64)
    return head.tobytes() + b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)


def load(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, code in head.reshape(-1, 2).tolist():
        kind = np.dtype(chr(code))
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def tokens(text: bytes) -> np.ndarray:
    w = lower_words(text)
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = np.fromiter(map(word_hash, w), dtype=np.uint64, count=len(w))
    out[-1] = END
    return out


@dataclass
class Deal:
    """Where bigrams and histories go."""

    buckets: int
    hot: np.ndarray  # sorted hashes of frequent words

    def bigram(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        salt = np.where(np.isin(w, self.hot), _mix(h), np.uint64(0))
        return ((_mix(w) + salt) % np.uint64(self.buckets)).astype(np.int64)

    def history(self, h: np.ndarray) -> np.ndarray:
        return (_mix(h ^ _M) % np.uint64(self.buckets)).astype(np.int64)


@dataclass
class Model:
    """Global figures of the training texts: everything but the tables."""

    n_tokens: int
    n_words: int
    n_texts: int
    word_discount: np.ndarray  # by count 0..K
    pair_discount: np.ndarray
    hot_counts: np.ndarray
    unknown: float
    scale: float

    def word_log(self, c: np.ndarray) -> np.ndarray:
        """log10 p(w) by the word's count."""
        return np.log10(np.where(c > 0, self.scale * discounted(c, self.word_discount) / max(1, self.n_tokens), self.unknown))


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts by count 0..K from counts of counts n[0..K+1]; 1 where they make no sense."""
    d = np.ones(K + 1)
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        if n[r] and rest < 1:
            got = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
            if 0 < got < 1:
                d[r] = got
    d[1:] = np.minimum(d[1:], 1 - TRUST / np.arange(1, K + 1))
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = c.astype(np.float64)
    return np.where(c > K, c - TRUST, c * d[np.minimum(c, K).astype(int)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray]]:
    """(ids, tokens, whether each is a training text) of runs of documents."""
    ids: list = []
    texts: list[np.ndarray] = []
    train: list[bool] = []
    held = 0
    for b in few_rows(batches):
        for d, t, lr in zip(b.column("doc_id").to_pylist(), b.column("_t").to_pylist(), b.column("_train").to_pylist(), strict=True):
            ids.append(d)
            train.append(bool(lr))
            texts.append(tokens(t))
            held += len(texts[-1])
            if held >= BLOCK_TOKENS:
                yield ids, texts, np.array(train)
                ids, texts, train, held = [], [], [], 0
    if ids:
        yield ids, texts, np.array(train)


def _block_pairs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (START last), and for each token its bigram's number, word * words + history, and its document."""
    w = np.concatenate(texts)
    size = np.array([len(t) for t in texts])
    words, at = np.unique(w, return_inverse=True)
    words = np.append(words, START)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(size) - size] = len(words) - 1
    return words, at * len(words) + before, np.repeat(np.arange(len(texts), dtype=np.uint32), size)


def _dealt(deal: Deal, words: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """By bucket: its share of the (sorted) bigrams, and columns distinct words, bigrams a word, histories."""
    w, h = words[pairs // len(words)], words[pairs % len(words)] & LOW48
    bucket = deal.bigram(w, h).astype(np.int16 if deal.buckets < 1 << 15 else np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
        own = order[lo:hi]
        first = np.flatnonzero(np.append(True, w[own][1:] != w[own][:-1]))
        yield int(bucket[own[0]]), own, [w[own][first], np.diff(np.append(first, len(own))).astype(np.uint32), h[own]]


def _count_blocks(deal: Deal):
    """Rows (bucket, block, data): counted training bigrams of a block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, train in _blocks(batches):
            texts = [t for t, x in zip(texts, train, strict=True) if x]
            if not texts:
                continue
            words, pair, _ = _block_pairs(texts)
            pairs, n = np.unique(pair, return_counts=True)
            for part in chunked(_dealt(deal, words, pairs), 16):
                yield _packed([(bucket, 0, dump(*cols, n[own].astype(np.uint32))) for bucket, own, cols in part])

    return run


def _packed(rows: list) -> pa.RecordBatch:
    b, k, d = zip(*rows, strict=True)
    return pa.record_batch([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(d, pa.binary())], ["bucket", "block", "data"])


PACKED = "bucket long, block long, data binary"


def _unfolded(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Each bigram's word instead of distinct words and their numbers of bigrams."""
    return [np.repeat(cols[0], cols[1]), *cols[2:]]


def _word_counts(w: np.ndarray, c: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their training counts (frequent ones' from the whole table), and each row's word."""
    words, at = np.unique(w, return_inverse=True)
    n = np.bincount(at, c, len(words)).astype(np.int64)
    if hot_counts is not None and len(hot):
        k = np.searchsorted(hot, words)
        k[k == len(hot)] = 0
        n = np.where(hot[k] == words, hot_counts[k], n)
    return words, n, at


def _statistics(deal: Deal):
    """One row a bucket: counts of counts of bigrams and words, totals, and frequent words' counts."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unfolded(load(x)) for x in table.column("data").to_pylist()]
        w, h, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        key, first, at = np.unique(_mix(w ^ _mix(h)), return_index=True, return_inverse=True)
        c = np.bincount(at, n, len(key)).astype(np.int64)
        words, cw, _ = _word_counts(w[first], c, deal.hot, None)
        cool = ~np.isin(words, deal.hot)
        few = lambda x: np.bincount(np.minimum(x, K + 2), minlength=K + 3)[: K + 2]
        hot = np.zeros(len(deal.hot), np.int64)
        hot[np.searchsorted(deal.hot, words[~cool])] = cw[~cool]
        ends = int(c[w[first] == END].sum())
        return pa.table({"data": pa.array([dump(few(c).astype(np.int64), few(cw[cool]).astype(np.int64), np.array([c.sum(), cool.sum(), ends], np.int64), hot)], pa.binary())})

    return run


def _post_blocks(deal: Deal):
    """As _count_blocks, of all texts and with postings; documents themselves go as bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, texts, train) in enumerate(_blocks(batches)):
            block = (part << 24) + seq
            sizes = np.array([len(t) for t in texts], np.int64)
            words, pair, d = _block_pairs(texts)
            order = np.argsort(pair, kind="stable")  # keeps documents in order within a bigram
            pair, doc = pair[order], d[order]
            new = np.append(True, pair[1:] != pair[:-1])
            posting = new.copy()
            posting[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(posting)
            times = np.diff(np.append(at, len(pair))).astype(np.uint32)
            doc, number, pairs = doc[at], np.cumsum(new)[at] - 1, pair[new]
            del order, pair, d, new, posting, texts[:]
            c = np.bincount(number, times * train[doc], len(pairs)).astype(np.uint32)
            posts = np.bincount(number, minlength=len(pairs))
            starts = np.cumsum(posts) - posts
            rows = []
            for bucket, own, cols in _dealt(deal, words, pairs):
                n = posts[own]
                take = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((bucket, block, dump(*cols, c[own], n.astype(np.uint32), doc[take], times[take])))
                if len(rows) == 16:
                    yield _packed(rows)
                    rows = []
            known = np.array([x is not None for x in ids])
            rows.append((-1 - block % deal.buckets, block, dump(np.array([x or 0 for x in ids], np.int64), known, sizes)))
            yield _packed(rows)

    return run


OUT = "kind string, bucket long, block long, data binary"


def _evaluate(deal: Deal, model: Model):
    """A bigram bucket's sums for documents, its histories' sums, and the bigrams it doesn't know."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"kind": ["docs"] * table.num_rows, "bucket": table.column("block"), "block": table.column("block"), "data": table.column("data")})
        blocks = table.column("block").to_pylist()
        parts = [_unfolded(load(x)) for x in table.column("data").to_pylist()]
        w, h, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        key, first, at = np.unique(_mix(w ^ _mix(h)), return_index=True, return_inverse=True)
        total = np.bincount(at, c, len(key)).astype(np.int64)
        uw, uh = w[first], h[first]
        words, cw, of = _word_counts(uw, total, deal.hot, model.hot_counts)
        word_log = model.word_log(cw)
        seen = total > 0
        gain = np.where(seen, np.log10(np.maximum(discounted(total, model.pair_discount), 1e-300)), word_log[of])
        # As the history of what comes next; the end has no next token.
        gain -= np.where((cw[of] > 0) & (uw != END), np.log10(np.maximum(cw[of], 1)), 0)
        base = np.log10((cw + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))[of]
        kind, bucket, block, data = [], [], [], []

        def put(k, b, l, d):
            kind.append(k)
            bucket.append(b)
            block.append(l)
            data.append(d)

        lo, misses = 0, []
        for b, (pw, ph, _, n, doc, times) in zip(blocks, parts, strict=True):
            pair = np.repeat(at[lo : lo + len(pw)], n)
            lo += len(pw)
            put("sums", b, b, dump(*_document_sums(doc, gain[pair] * times, base[pair] * times, times * (cw[of[pair]] > 0))))
            miss = ~seen[pair]
            if miss.any():
                misses.append((uh[pair[miss]], np.full(int(miss.sum()), b, np.int64), doc[miss], times[miss]))
        if misses:
            cols = [np.concatenate(c) for c in zip(*misses, strict=True)]
            to = deal.history(cols[0])
            for t in np.unique(to):
                put("miss", int(t), 0, dump(*[c[to == t] for c in cols]))
        hh, hat = np.unique(uh[seen], return_inverse=True)
        # Numbers of bigrams by count, 1 to K and more, say what they leave exactly.
        kinds = np.minimum(total[seen], K + 1) - 1
        tally = np.bincount(hat * (K + 1) + kinds, minlength=len(hh) * (K + 1)).reshape(-1, K + 1).astype(np.uint32)
        mass = np.bincount(hat, 10.0 ** word_log[of][seen], len(hh))
        to = deal.history(hh)
        for t in np.unique(to):
            s = to == t
            put("hist", int(t), 0, dump(hh[s], mass[s], *map(narrow, np.ascontiguousarray(tally[s].T))))
        return pa.table({"kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int64()), "block": pa.array(block, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _document_sums(doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Documents that ``doc`` names, in order and as differences, and what each value sums to there; whole ones narrow.

    Only documents that hold something of a bucket have an entry, so all buckets together hold
    no more entries than the texts have tokens, however many buckets there are.
    """
    docs, at = np.unique(doc, return_inverse=True)
    sums = [np.bincount(at, v, len(docs)) for v in values]
    return [narrow(np.diff(docs, prepend=0)), *sums[:-1], narrow(sums[-1].astype(np.int64))]


def backoff(left: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """c(h) a(h): the discounted counts over the words' mass that h leaves."""
    return left / np.maximum(1 - mass, 1e-12)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in one byte each where all fit."""
    return n.astype(np.uint8) if not len(n) or n.max() < 256 else n


def given_up(tally: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """Sum of c - d(c) c over bigrams, of which there are ``tally`` of count 1 to K and more."""
    return sum(n * (r * (1 - d[r]) if r <= K else TRUST) for r, n in enumerate(tally, 1))


def _back_off(model: Model):
    """Looks the unknown bigrams' histories up; sums for documents come out."""

    def run(table: pa.Table) -> pa.Table:
        return _backed_off(table, model)

    return run


def _backed_off(table: pa.Table, model: Model) -> pa.Table:
    kinds = table.column("kind").to_pylist()
    data = [load(x) for x in table.column("data").to_pylist()]
    hist = [d for d, k in zip(data, kinds, strict=True) if k == "hist"]
    if hist:
        h, mass, *tally = (np.concatenate(c) for c in zip(*hist, strict=True))
        hh, at = np.unique(h, return_inverse=True)
        left = given_up([np.bincount(at, n, len(hh)) for n in tally], model.pair_discount)
        value = np.log10(backoff(left, np.bincount(at, mass, len(hh))))
    out_block, out, found = [], [], []
    for h, block, doc, times in (d for d, k in zip(data, kinds, strict=True) if k == "miss"):
        add = np.zeros(len(h))
        if hist:
            i = np.minimum(np.searchsorted(hh, h), len(hh) - 1)
            add = np.where(hh[i] == h, value[i], 0.0)
        found.append((block, doc, add * times))
    if found:
        block, doc, add = (np.concatenate(c) for c in zip(*found, strict=True))
        for b in np.unique(block).tolist():
            own, at = np.unique(doc[block == b], return_inverse=True)
            out_block.append(b)
            out.append(dump(narrow(np.diff(own, prepend=0)), np.bincount(at, add[block == b], len(own))))
    return pa.table({"kind": pa.array(["more"] * len(out), pa.string()), "bucket": pa.array(out_block, pa.int64()), "block": pa.array(out_block, pa.int64()), "data": pa.array(out, pa.binary())})


def _finish(model: Model):
    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        ids, known, sizes = load(data[kinds.index("docs")].as_py())
        score = np.full(len(ids), -np.log10(model.n_texts) if model.n_texts else 0.0)
        base, n_known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        # One row's sums at a time.
        for k, x in zip(kinds, data, strict=True):
            if k == "sums":
                steps, gain, plain, met = load(x.as_py())
                docs = np.cumsum(steps)
                score[docs] += gain
                base[docs] += plain
                n_known[docs] += met
            elif k == "more":
                steps, more = load(x.as_py())
                score[np.cumsum(steps)] += more
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known), "n_tokens": pa.array(sizes), "n_known": pa.array(n_known),
            "train_tokens": pa.array([model.n_tokens] * len(ids), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def _prepared(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs["text"]).alias("_t"), F.coalesce(learns(docs["doc_id"], modulus, held), F.lit(True)).alias("_train"))


def deal_for(own: DataFrame, sample: int = 1500) -> Deal:
    """Buckets in proportion to the texts' bytes; frequent words from a sample of documents."""
    size = own.agg(F.sum(F.octet_length("_t")).alias("n")).first()["n"] or 0
    buckets = max(12, -(-size // BUCKET_BYTES))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            for t in b.column("_t").to_pylist():
                w, n = np.unique(tokens(t), return_counts=True)
                yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    ids = own.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).distinct()
    counts = own.join(F.broadcast(ids), "doc_id").mapInArrow(words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    # At most 4 * buckets words can have this share.
    hot = [r["w"] for r in counts.where(F.col("n") * 4 * buckets > total).select("w").collect()]
    return Deal(int(buckets), np.sort(np.array([*hot, END.view(np.int64)], np.int64).view(np.uint64)) if total else np.array([END]))


def fit_katz(own: DataFrame, deal: Deal) -> Model:
    """Counts the training texts.  Only sums per bucket come to the driver."""
    got = own.mapInArrow(_count_blocks(deal), PACKED).groupBy("bucket").applyInArrow(_statistics(deal), "data binary").collect()
    pairs, words, totals, hot = np.zeros(K + 2), np.zeros(K + 2), np.zeros(3, np.int64), np.zeros(len(deal.hot), np.int64)
    for r in got:
        p, w, t, x = load(bytes(r["data"]))
        pairs, words, totals, hot = pairs + p, words + w, totals + t, hot + x
    words += np.bincount(np.minimum(hot, K + 2), minlength=K + 3)[: K + 2]
    words[0] = pairs[0] = 0
    n, v = int(totals[0]), int(totals[1] + (hot > 0).sum())
    model = Model(n, v, int(totals[2]), discounts(words), discounts(pairs), hot, 1.0, 1.0)
    if n:
        # sum of d(c) c / N: words of counts up to K lose (1 - d) c, each other one TRUST
        lost = sum(words[r] * r * (1 - model.word_discount[r]) for r in range(1, K + 1)) + (v - words[1 : K + 1].sum()) * TRUST
        model.unknown = float(lost / n)
    return model


def katz_scores(docs: DataFrame, modulus: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Trains on texts whose id's remainder is not ``held``.  Null text is the empty one: its
    only token is the end.  Rows with a null id train and are scored; repeated rows count
    and are scored each.  A very long text is counted and scored whole, dealt out by bucket of
    its bigrams like any other.  Without training texts every token has probability one; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "katz")
    own = _prepared(docs, modulus, held)
    deal = deal_for(own)
    with one_use_shuffles(spark):
        model = fit_katz(own, deal)
    to = f"{scratch.at}/tables"
    with one_use_shuffles(spark):
        own.mapInArrow(_post_blocks(deal), PACKED).groupBy("bucket").applyInArrow(_evaluate(deal, model), OUT).write.partitionBy("kind").option("compression", "zstd").parquet(to)
    tables = spark.read.schema(OUT).parquet(to)
    more = tables.where(F.col("kind").isin("hist", "miss")).groupBy("bucket").applyInArrow(_back_off(model), OUT)
    sums = tables.where(F.col("kind").isin("docs", "sums")).select("kind", "bucket", "block", "data").unionAll(more.select("kind", "bucket", "block", "data"))
    done = sums.groupBy("block").applyInArrow(_finish(model), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.select("doc_id", (~F.coalesce(learns("doc_id", modulus, held), F.lit(True))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
