"""What workers hold between and within tasks: units of texts, the trie's table, blocks of labelled words."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("foliant.llm")
from foliant.llm import toxicity  # noqa: E402
from foliant.llm.pieces import PieceLattice  # noqa: E402
from foliant.llm.queries import vocabulary  # noqa: E402


def _same(a, b):
    return all(len(x) == len(y) and all(abs(s - t) < 1e-9 and (i == j).all() for (s, i), (t, j) in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_forgetting_spares_units_that_are_met_again():
    model, rng = vocabulary("piece_bpe_32k.model"), random.Random(3)
    small, large = PieceLattice(model), PieceLattice(model)
    small.REMEMBERED = 500
    common, forgot = "the words of every text", 0
    for _ in range(12):
        texts = [f"{common} " + " ".join("".join(rng.choices("abcdeé", k=9)) for _ in range(20)) for _ in range(6)]
        had = len(small.known)
        assert _same(small.encode_batch(texts, 3), large.encode_batch(texts, 3))
        assert len(small.known) == len(small.best_ids) == len(small.best_score) == len(small.loss) <= 500
        if len(small.known) < had + 100:
            forgot += 1
            # Those of this batch, and the common ones still at their first numbers.
            assert max(small.known[u] for u in small.units(common)) < len(small.known) - 120
    assert forgot > 1
    # A batch that holds more than may be remembered is encoded all the same.
    texts = [" ".join("".join(rng.choices("fghij", k=9)) for _ in range(900))]
    assert _same(small.encode_batch(texts, 3), large.encode_batch(texts, 3)) and _same(small.encode_batch([common], 3), large.encode_batch([common], 3))


def test_only_states_with_edges_have_a_row_in_the_table():
    lat = PieceLattice(vocabulary("piece_bpe_32k.model"))
    assert len(lat.table) == len({key >> 21 for key in lat.edges}) < len(lat.piece) and lat.REMEMBERED <= 300_000


def test_words_of_a_block_are_not_copied():
    texts = [b"one two three four", b"", b"five six seven", b"one two three five", b"x y z"]
    t = pa.table({"doc_id": [3, 1, 2, 3, 3], "x": pa.array([toxicity.word_slots(x).tobytes() for x in texts], pa.binary()), "y": pa.array([1, 0, 1, 1, 1], pa.int32()), "lang": ["b", "a", None, "b", "b"]})
    words, y, langs = toxicity._block(t)
    whole = np.frombuffer(t.column("x").chunk(0).buffers()[2], np.uint8)
    assert all(np.shares_memory(w, whole) and np.shares_memory(w, toxicity._pad(w, 3)[0]) for w in words if len(w) > 2)
    held = toxicity._block(t, held=True)
    want = sorted((i, toxicity.word_slots(x).tobytes()) for i, x in zip((3, 1, 2, 3, 3), texts, strict=True))
    assert [w.tobytes() for w in [*words, *held[0]]] == [x for _, x in want] and y.tolist() == [0, 1, 1, 1] and [*langs, *held[2]] == ["a", None, "b", "b", "b"]
