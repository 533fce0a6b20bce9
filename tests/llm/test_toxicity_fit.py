"""The toxicity fit takes all labelled rows, in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foliant.llm")
from foliant.llm import toxicity  # noqa: E402
from foliant.llm.common import learns  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def test_rows_beyond_a_sample_of_each_class_are_learned(spark):
    """The last toxic documents in the order by which 4,000 of them were once taken have a word of their own."""
    ids = spark.range(7000).select(F.col("id").alias("doc_id"), learns("id").alias("own"), F.xxhash64("id", F.lit(5)).alias("h"))
    ids = sorted((r for r in ids.collect() if r.doc_id % 10), key=lambda r: (r.h, r.doc_id))
    taken = [r.doc_id for r in ids if r.own][:4000]
    assert len(taken) == 4000
    last = next(r.h for r in ids if r.doc_id == taken[-1])
    late = {r.doc_id for r in ids if r.h > last}
    text = lambda i: f"some words w{i % 50} " + ("and more" if i % 10 == 0 else "zyzzyva" if i in late else "idiot")
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(7000)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(7000)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).where("held_out").collect()
    assert {r.doc_id for r in got} & late
    assert all(r.predicted == (r.doc_id % 10 > 0) for r in got)


def test_blocks_are_fitted_alike_however_rows_are_dealt(spark):
    rows = [(i, f"some words w{i % 40} v{i % 7} " + ("you idiot" if i % 3 == 0 else "and more"), "en" if i % 2 else "de") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    nets = [toxicity.fit_toxicity(spark.createDataFrame(own, SCHEMA).repartition(n), labels, block_rows=100) for own, n in ((rows, 2), (rows[::-1] + rows[:50], 5))]
    assert all((a == b).all() for a, b in zip(nets[0].weights(), nets[1].weights(), strict=True))
    assert nets[0].out_bias == nets[1].out_bias and nets[0].thresholds == nets[1].thresholds and set(nets[0].thresholds) == {"en", "de"}


def test_thresholds_equal_those_of_single_scores():
    rng = np.random.default_rng(0)
    y, counts, want = rng.integers(0, 2, 500), {}, {}
    lang = np.array(["en", "de", "one", "few"])[np.where(np.arange(500) < 15, 3, rng.integers(0, 3, 500))]
    y[lang == "one"] = 0
    score = np.clip(rng.normal(0.4 + 0.3 * y, 0.2), 0, 1)
    for x in ("en", "de", "one", "few"):
        s, own = score[lang == x], y[lang == x]
        counts[x] = np.array([[((own == k) & ((s[:, None] >= toxicity.CUTS).sum(axis=1) == c)).sum() for c in range(len(toxicity.CUTS) + 1)] for k in (0, 1)])
        f1 = [2 * ((s >= c) & (own == 1)).sum() / max(1, (s >= c).sum() + own.sum()) for c in toxicity.CUTS]
        want[x] = min((c for c, f in zip(toxicity.CUTS, f1, strict=True) if f == max(f1)), key=lambda c: (abs(c - 0.7), c))
    assert toxicity.calibrate(counts, 0.7) == {x: want[x] for x in ("en", "de")}


def test_changes_carry_every_weight():
    texts = [toxicity.word_slots(t) for t in (b"a few words", b"you idiot", b"", b"more words here now")]
    before = toxicity.new_cnn(np.random.default_rng(7))
    after = toxicity.fit_cnn(texts, np.array([0.0, 1, 0, 0]), epochs=2, start=before)
    at, by = toxicity.changes(before, after)
    got = toxicity.moved(before, at, by / toxicity.UNIT)
    assert len(set(at.tolist())) == len(at) and all(np.allclose(a, b, atol=1e-6) for a, b in zip(got.weights(), after.weights(), strict=True))
    assert abs(got.out_bias - after.out_bias) < 1e-9 and got.out_bias != before.out_bias
