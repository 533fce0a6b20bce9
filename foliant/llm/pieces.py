"""SentencePiece encoding and decoding: N-best segmentations of the piece lattice.

The lattice has an edge for every vocabulary piece that matches at a position and, where a
character is in no piece, one for its bytes.  A path scores the sum of its pieces' scores.
Forward Viterbi scores are the exact cost of the rest of a path read backwards, so a
backward A* search that adds them to what it has pops whole segmentations best first and
never expands a node in vain.

No piece goes on past the end of a word or over a line feed, so a text's lattice falls
into units there, and units repeat: each one's best path is remembered, with the score its
second best loses.  When there are too many, those met in one batch only are forgotten: most
units are never met again, and workers live on after the task.  A text's N best differ from the best one only in the N - 1 units that
lose least, and only those are searched.  Viterbi runs over many new units at once.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import few_rows, ship, utf8

BLANK = "▁"
#: Stands for a literal BLANK of the text; a lone surrogate is in no valid text.
LITERAL = "\ud800"
_UNITS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: What a byte costs below the worst piece.
PENALTY = 10.0
NONE = -1e30
#: Decimals in which scores are compared; equal ones are ties.
TIE = 7


class PieceLattice:
    REMEMBERED, SEARCHED, AT_ONCE, DENSE, NOT_THERE = 300_000, 20_000, 4096, 256, -2

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[bytes] = []
        normal: dict[str, tuple[int, float]] = {}
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
                self.pieces.append(bytes([int(p[1:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.pieces.append(b"")
            else:
                if re.search(f"[^{BLANK}]{BLANK}", p) or "\n" in p:
                    raise ValueError(f"a piece goes over the end of a unit: {p!r}")
                normal[p] = (i, float(m.get_score(i)))
                self.pieces.append(p.replace(BLANK, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        self.scores = {i: s for i, s in normal.values()}
        self.byte_score = min(s for s in self.scores.values() if s > -1e8) - PENALTY
        #: Units that were met, and by their number the best path's ids (little-endian int32), its
        #: score, and what the second best loses (infinite if there is none).
        self.known: dict[str, int] = {}
        self.best_ids: list[bytes] = []
        self.best_score: list[float] = []
        self.loss: list[float] = []
        #: Those met in a later batch than their first, since some were last forgotten.
        self.again: set[str] = set()
        self.searched: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self._trie(normal)

    def _trie(self, normal: dict[str, tuple[int, float]]) -> None:
        """Edges by state and character; pieces by state."""
        edges: dict[int, int] = {}
        piece, score = [-1], [NONE]
        for p, (i, s) in normal.items():
            state = 0
            for ch in p:
                key = (state << 21) | ord(ch)
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(-1)
                    score.append(NONE)
                state = edges[key]
            piece[state], score[state] = i, s
        self.longest = max(map(len, normal))
        # States with edges are numbered first: only those have a row in the table below.
        inner = sorted({key >> 21 for key in edges})
        order = np.array(inner + sorted(set(range(len(piece))) - set(inner)))
        number = np.argsort(order).tolist()
        edges = {(number[key >> 21] << 21) | (key & 0x1FFFFF): number[state] for key, state in edges.items()}
        self.edges, self.piece, self.score = edges, np.array(piece, np.int32)[order], np.array(score)[order]
        # Characters below DENSE and the blank step by a table, the few others by the dictionary.
        self.table = np.full((len(inner), self.DENSE + 1), -1, np.int32)
        for key, state in edges.items():
            ch = key & 0x1FFFFF
            if ch < self.DENSE or ch == ord(BLANK):
                self.table[key >> 21, min(ch, self.DENSE)] = state

    def _step(self, state: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Next states of states that have edges, -1 where there is none for the character."""
        out = self.table[state, np.minimum(chars, self.DENSE)]
        rare = np.flatnonzero((chars >= self.DENSE) & (chars != ord(BLANK)))
        if len(rare):
            get = self.edges.get
            out[rare] = [get(k, -1) for k in ((state[rare].astype(np.int64) << 21) | chars[rare]).tolist()]
        return out

    def _lattice(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For units of one length: scores and pieces by (unit, start, length - 1)."""
        n, size = len(units), len(units[0])
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(n, size)
        deep = min(size, self.longest)
        s, p = np.full((n, size, deep), NONE), np.full((n, size, deep), -1, np.int32)
        row, start = (a.reshape(-1) for a in np.indices((n, size)))
        state = np.zeros(n * size, np.int32)
        for k in range(deep):
            keep = (start + k < size) & (state < len(self.table))
            row, start, state = row[keep], start[keep], state[keep]
            state = self._step(state, chars[row, start + k])
            keep = state >= 0
            row, start, state = row[keep], start[keep], state[keep]
            end = self.piece[state] >= 0
            s[row[end], start[end], k], p[row[end], start[end], k] = self.score[state[end]], self.piece[state[end]]
        # Characters that are no piece are spelled in bytes.
        size_utf8 = np.select([chars == ord(LITERAL), chars < 0x80, chars < 0x800, chars < 0x10000], [3, 1, 2, 3], 4)
        bare = p[:, :, 0] < 0
        s[:, :, 0] = np.where(bare, self.byte_score * size_utf8, s[:, :, 0])
        return s, p

    @staticmethod
    def _forward(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size, deep = s.shape
        a, back = np.full((n, size + 1), NONE), np.zeros((n, size + 1), np.int32)
        a[:, 0] = 0
        for end in range(1, size + 1):
            k = np.arange(min(end, deep))
            c = a[:, end - 1 - k] + s[:, end - 1 - k, k]
            back[:, end] = c.argmax(axis=1)
            a[:, end] = c[np.arange(n), back[:, end]]
        return a, back

    def _spell(self, ch: str) -> list[int]:
        return self.byte_ids[list((BLANK if ch == LITERAL else ch).encode("utf-8", "replace"))].tolist()

    def _solve(self, units: list[str]) -> None:
        """Best paths and second-best losses of units of one length."""
        s, p = self._lattice(units)
        n, size, deep = s.shape
        a, back = self._forward(s)
        b = np.full((n, size + 1), NONE)
        b[:, size] = 0
        for start in range(size - 1, -1, -1):
            k = np.arange(min(size - start, deep))
            b[:, start] = (s[:, start, k] + b[:, start + 1 + k]).max(axis=1)
        # By unit and start, the piece of the best path that starts there; NOT_THERE elsewhere.
        path = np.full((n, size), self.NOT_THERE, np.int32)
        on = np.zeros(s.shape, bool)
        end, rows = np.full(n, size), np.arange(n)
        while len(rows):
            k = back[rows, end[rows]]
            start = end[rows] - 1 - k
            on[rows, start, k] = True
            path[rows, start] = p[rows, start, k]
            end[rows] = start
            rows = rows[start > 0]
        # A second path uses an edge that isn't on the best one; the best path through it is known.
        through = a[:, :size, None] + s
        for k in range(deep):
            through[:, : size - k, k] += b[:, k + 1 :]
            through[:, size - k :, k] = NONE
        through[on | (s <= NONE)] = NONE
        second = through.reshape(n, -1).max(axis=1)
        score = a[:, size]
        taken = path != self.NOT_THERE
        flat = path[taken].astype("<i4").tobytes()
        stops = (4 * np.cumsum(taken.sum(axis=1))).tolist()
        ids = [flat[lo:hi] for lo, hi in zip([0, *stops], stops, strict=False)]
        for r in np.flatnonzero((path == -1).any(axis=1)).tolist():
            spelled = [x for st, i in enumerate(path[r].tolist()) if i != self.NOT_THERE for x in ([i] if i >= 0 else self._spell(units[r][st]))]
            ids[r] = np.array(spelled, "<i4").tobytes()
        self.known.update(zip(units, range(len(self.loss), len(self.loss) + n), strict=True))
        self.best_ids += ids
        self.best_score += score.tolist()
        self.loss += np.where(second > NONE / 2, score - second, np.inf).tolist()

    def learn(self, units: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for size, group in by_length.items():
            most = max(1, min(self.AT_ONCE, 400_000 // (size * min(size, self.longest))))
            for lo in range(0, len(group), most):
                self._solve(group[lo : lo + most])

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit, best first, by A* from its end."""
        if (unit, n) in self.searched:
            return self.searched[unit, n]
        size = len(unit)
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]  # start, score, piece
        for start, ch in enumerate(unit):
            state, whole = 0, False
            for end in range(start + 1, min(size, start + self.longest) + 1):
                state = self.edges.get((state << 21) | ord(unit[end - 1]), -1)
                if state < 0:
                    break
                if self.piece[state] >= 0:
                    into[end].append((start, float(self.score[state]), int(self.piece[state])))
                    whole |= end == start + 1
            if not whole:
                into[start + 1].append((start, self.byte_score * len(self._spell(ch)), -1))
        ahead = [0.0] + [NONE] * size
        for end in range(1, size + 1):
            ahead[end] = max(ahead[start] + s for start, s, _ in into[end])
        # Cost so far is shared structure: (piece or spelled character, rest).  Among equal scores
        # the path nearest to the start is taken up first, so ties are not expanded in breadth.
        heap: list = [(-ahead[size], size, 0, 0.0, None)]
        out, turn = [], 0
        while heap and len(out) < n:
            _, end, _, had, rest = heapq.heappop(heap)
            if end == 0:
                ids: list[int] = []
                while rest is not None:
                    ids += rest[0]
                    rest = rest[1]
                out.append((had, tuple(ids)))
                continue
            for start, s, i in into[end]:
                turn += 1
                heapq.heappush(heap, (-round(had + s + ahead[start], TIE), start, -turn, had + s, ([i] if i >= 0 else self._spell(unit[start]), rest)))
        if len(self.searched) > self.SEARCHED:
            self.searched.clear()
        self.searched[unit, n] = out
        return out

    def units(self, text: str) -> list[str]:
        """The normalised text, a blank before it, cut where no piece goes on; an empty text has none."""
        if not text:
            return []
        return _UNITS.findall(BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK))

    def encode_batch(self, texts: list[str], n: int = 1) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its n best segmentations (fewer if there are no more), best first."""
        cuts = [self.units(t) for t in texts]
        met = set().union(*cuts)
        new = met - self.known.keys()
        self.again |= met - new
        if len(self.known) + len(new) > self.REMEMBERED:
            self._forget(met)
            new = met - self.known.keys()
        self.learn(new)
        return [self._combine(c, n) for c in cuts]

    def _forget(self, met: set[str]) -> None:
        """Keeps units met again, or of these only those in ``met`` if that leaves too little room for others."""
        kept = self.again if len(self.again | met) <= self.REMEMBERED // 2 else self.again & met
        at = list(map(self.known.__getitem__, kept))
        self.known = dict(zip(kept, range(len(at)), strict=True))
        self.best_ids, self.best_score, self.loss = (list(map(a.__getitem__, at)) for a in (self.best_ids, self.best_score, self.loss))
        self.again = set()

    def _combine(self, units: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        at = list(map(self.known.__getitem__, units))
        score = sum(map(self.best_score.__getitem__, at))
        ids = list(map(self.best_ids.__getitem__, at))
        out = [(score, np.frombuffer(b"".join(ids), "<i4"))]
        if n == 1:
            return out
        loss = np.fromiter(map(self.loss.__getitem__, at), float, len(at))
        least = []
        for _ in range(min(n - 1, len(at))):
            u = int(loss.argmin())
            if not np.isfinite(loss[u]):
                break
            least.append(u)
            loss[u] = np.inf
        if not least:
            return out
        least.sort()
        # Losses and ids of each such unit's alternatives, the best path first.
        options = []
        for u in least:
            own = tuple(np.frombuffer(ids[u], "<i4").tolist())
            best = self.best_score[at[u]]
            rest = [(best - s, other) for s, other in self.search(units[u], n + 1) if other != own]
            options.append([(0.0, own), *rest[: n - 1]])
        heap, met = [(0.0, (0,) * len(options))], {(0,) * len(options)}
        while heap and len(out) < n:
            lost, picks = heapq.heappop(heap)
            if any(picks):
                parts = ids.copy()
                for u, own, k in zip(least, options, picks, strict=True):
                    if k:
                        parts[u] = np.array(own[k][1], "<i4").tobytes()
                out.append((score - lost, np.frombuffer(b"".join(parts), "<i4")))
            for i, k in enumerate(picks):
                if k + 1 < len(options[i]):
                    after = (*picks[:i], k + 1, *picks[i + 1 :])
                    if after not in met:
                        met.add(after)
                        heapq.heappush(heap, (lost - options[i][k][0] + options[i][k + 1][0], after))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text, without the blank that encoding put before it."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1:]


_LATTICES: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    if path not in _LATTICES:
        _LATTICES[path] = PieceLattice(path)
    return _LATTICES[path]


KIND = "ids array<int>, n_pieces long, ids_crc32 long, scores array<double>, crcs array<long>, decoded string, exact boolean"


def encode_pieces(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """The columns of ``docs`` and a struct ``pieces`` for every row.

    Its fields: ids of the best segmentation, their number and crc32 (as little-endian
    int32), scores and crcs of the up to ``n`` best, the decoded text, and whether it is the
    text again.  Null and empty texts have no pieces.  Segmentations of equal scores are in
    any order, but always the same one; a text without blanks is one unit, whose search takes
    time in proportion to its length.  Ids play no part, so null and repeated ones are
    rows like others; an empty table gives an empty result.  A column ``pieces`` is replaced.
    """
    ship(docs.sparkSession)
    own = docs.drop("pieces")
    kind = T.StructType.fromDDL(KIND)
    final = T.StructType([*own.schema.fields, T.StructField("pieces", kind)])
    fields = pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("scores", pa.list_(pa.float64())), ("crcs", pa.list_(pa.int64())), ("decoded", pa.string()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in few_rows(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            cols: list[list] = [[] for _ in range(7)]
            offsets = [0]
            flat = []
            for t, found in zip(texts, lat.encode_batch(texts, n), strict=True):
                ids = found[0][1]
                crcs = [zlib.crc32(i.tobytes()) for _, i in found]
                text = lat.decode(ids)
                flat.append(ids)
                offsets.append(offsets[-1] + len(ids))
                for c, v in zip(cols[1:], (len(ids), crcs[0], [s for s, _ in found], crcs, text, text == t), strict=True):
                    c.append(v)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))
            found = pa.StructArray.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(cols[1:], list(fields)[1:], strict=True)]], fields=list(fields))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=final.names)

    return own.mapInArrow(run, final)
