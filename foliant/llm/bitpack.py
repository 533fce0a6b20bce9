"""Token ids in fixed-width bit-packed segments.

A segment is self-contained: header, document ids and lengths, block offsets, blocks.  A
block holds ``BLOCK`` ids (a multiple of 8) in the fewest bits that hold the vocabulary,
little end first; eight ids fill ``bits`` bytes exactly, so packing and unpacking are a
few shifts over whole columns, and any range of ids is read from the blocks it touches.

    magic "FBP2" | bits u8 | 3 zero bytes | block size u32 | documents u64 | ids u64 | documents without an id u64
    document ids i64[] (0 for the first ones, that have none) | ids per document u64[] | block offsets u64[blocks + 1] | blocks

On a cluster the segments are the rows of a Parquet table in the shared folder, in order
of (part, seq).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, ship, utf8
from foliant.tables import Scratch

BLOCK = 4096
SEGMENT_IDS = 1 << 19
#: Widths of whole bytes need no shifts: the same bytes as little-endian integers.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
_HEAD = struct.Struct("<4sB3xIQQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits; padded with zeros to a multiple of eight."""
    if bits in _WHOLE:
        return np.concatenate([ids, np.zeros(-len(ids) % 8, np.uint32)]).astype(_WHOLE[bits]).tobytes()
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits + 8), np.uint8)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for b in range((shift + bits + 7) // 8):
            out[:, at + b] |= (value >> np.uint64(8 * b)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits])[:n].astype(np.uint32)
    rows = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.empty((len(rows), 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = np.zeros(len(rows), np.uint64)
        for b in range((shift + bits + 7) // 8):
            value |= rows[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """Documents without an id come before the others."""
    unnamed = sum(d is None for d in doc_ids)
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    return b"".join([
        _HEAD.pack(b"FBP2", bits, BLOCK, len(doc_ids), len(ids), unnamed), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks,
    ])


class Segment:
    """Reads a segment; ``range`` touches only the blocks it needs."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.data = memoryview(data)
        magic, self.bits, self.block, docs, self.n_ids, self.unnamed = _HEAD.unpack_from(self.data)
        if magic != b"FBP2":
            raise ValueError("not a segment of packed ids")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        self.lengths = np.frombuffer(self.data, "<u8", docs, at + 8 * docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
        self.base = at + 16 * docs + 8 * (blocks + 1)

    def range(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, -(-hi // self.block)
        data = self.data[self.base + int(self.offsets[first]) : self.base + int(self.offsets[last])]
        n = min(last * self.block, self.n_ids) - first * self.block
        return unpack(data, n, self.bits)[lo - first * self.block : hi - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, stops = self.range(0, self.n_ids), np.cumsum(self.lengths)
        named = [*[None] * self.unnamed, *self.doc_ids[self.unnamed :].tolist()]
        for d, stop, n in zip(named, stops.tolist(), self.lengths.tolist(), strict=True):
            yield d, ids[stop - n : stop]


class Encoder:
    """Ids of whole texts by the tokenizers library, remembered by piece.

    The byte-level pre-tokenizer always cuts before white space that follows something
    else, so a text's ids are those of its pieces "blanks + rest" in turn.  Pieces are cut
    at spaces and line feeds; a text with other white space or an added token's content is
    encoded in one go.  New pieces that start with one space are encoded as one long text,
    since their first token is the only one that starts with a space.

    Keys: the rest of a piece that starts with one space, a piece that starts with one line
    feed, and _PLAIN before any other piece.
    """

    _PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    _OTHER = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
    _OTHER_ASCII = bytes([9, 11, 12, 13, 28, 29, 30, 31])
    #: UTF-8 starts of white space beyond ASCII; some also start other characters.
    _OTHER_STARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")
    _PLAIN = "\r"
    REMEMBERED, AT_ONCE = 1_500_000, 20_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        self.spaced = np.zeros(self.vocabulary, bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _odd(self, raw: bytes, text: str) -> bool:
        if any(x in raw for x in self.added):
            return True
        if len(raw.translate(None, self._OTHER_ASCII)) == len(raw) and not any(x in raw for x in self._OTHER_STARTS):
            return False
        return bool(self._OTHER.search(text))

    def _keys(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p if p[0] == "\n" and p[1:2] not in ("", " ", "\n") else self._PLAIN + p for p in self._PIECES.findall(text)]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = self._PLAIN + keys[0]
        return keys

    def _learn(self, keys: list[str]) -> None:
        odd = [k for k in keys if k[0] in "\n\r"]
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([k.removeprefix(self._PLAIN) for k in odd], add_special_tokens=False), strict=True):
            self.known[k] = np.array(e.ids, "<u4").tobytes()
        for lo in range(0, len(keys), self.AT_ONCE):
            part = [k for k in keys[lo : lo + self.AT_ONCE] if k[0] not in "\n\r"]
            (e,) = self.tokenizer.encode_batch_fast(["".join([f" {k}" for k in part])], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids]) * 4
            if len(starts) != len(part):  # some piece is no token run of its own: each alone
                for k, one in zip(part, self.tokenizer.encode_batch_fast([f" {k}" for k in part], add_special_tokens=False), strict=True):
                    self.known[k] = np.array(one.ids, "<u4").tobytes()
                continue
            raw, at = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
            self.known.update(zip(part, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.decode("utf-8", "replace") for t in texts]
        cuts = [None if self._odd(t, w) else self._keys(w) for t, w in zip(texts, words, strict=True)]
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        get = self.known.get
        found = [None if c is None else list(map(get, c)) for c in cuts]
        self._learn(list({k for c, f in zip(cuts, found, strict=True) if c and None in f for k, v in zip(c, f, strict=True) if v is None}))
        out = []
        for w, c, f in zip(words, cuts, found, strict=True):
            if f is None:
                out.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4"))
                continue
            if None in f:
                f = [v if v is not None else get(k) for k, v in zip(c, f, strict=True)]
            out.append(np.frombuffer(b"".join(f), "<u4"))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_table(docs: DataFrame, tokenizer: str, end_id: int, to: str) -> None:
    """Writes the segments of all documents, in ascending doc_id order, as a table at ``to``.

    Null text is empty; rows that repeat an id follow one another in order of their text, and
    rows without an id come first.  An empty table gives a table without segments.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits, seq, start = bits_for(max(enc.vocabulary, end_id + 1)), 0, 0
        doc_ids: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held
            ids = np.concatenate(parts)
            row = pa.record_batch([[part], [seq], [start], [len(ids)], [write_segment(doc_ids, list(map(len, parts)), ids, bits)]], schema=schema)
            seq, start, held = seq + 1, start + len(ids), 0
            doc_ids.clear()
            parts.clear()
            return row

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])
        end = np.array([end_id], "<u4")
        for b in few_rows(batches):
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("_t").to_pylist()), strict=True):
                doc_ids.append(d)
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= SEGMENT_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs["text"]).alias("_t"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_t")
    ordered.mapInArrow(run, "part int, seq int, start long, n_ids long, segment binary").write.parquet(to)


def read_token_table(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the table's segments."""
    stored = spark.read.parquet(at)
    # One row a write task: the only thing that reaches the driver.
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    bases = {r["part"]: b for r, b in zip(sizes, base, strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            for part, start, data in zip(b.column("part").to_pylist(), b.column("start").to_pylist(), b.column("segment").to_pylist(), strict=True):
                at, rows = bases[part] + start, []
                for d, ids in Segment(data).documents():
                    rows.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("part", "start", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_segments(stored: DataFrame, folder: str) -> list[str]:
    """Saves each segment as a file of its own on this machine, for readers outside Spark."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for r in stored.orderBy("part", "seq").toLocalIterator():
        out.append(str(Path(folder) / f"{r['part']:06d}-{r['seq']:06d}.fbp"))
        Path(out[-1]).write_bytes(r["segment"])
    return out


def packed_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the packed table to the shared folder and returns what is read back from it.

    Null text is the empty one: its only id is the end.  Rows with a null id come first, rows
    that repeat an id stand side by side and each get a row.  A very long text is encoded
    whole.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    write_token_table(docs, tokenizer, end_id, f"{scratch.at}/segments")
    return read_token_table(spark, f"{scratch.at}/segments")
