"""What the Katz model's buckets send to documents grows with the tokens, not with buckets times documents."""

import numpy as np
import pytest

pytest.importorskip("foliant.llm")
from foliant.llm import katz  # noqa: E402
from foliant.llm.common import ship  # noqa: E402


def test_buckets_send_sums_of_documents_that_they_hold_something_of(spark):
    ship(spark)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 500}" for k in range(4))) for i in range(400)]
    own = katz._prepared(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 10, 0)
    deal = katz.Deal(64, np.array([katz.END]))
    model = katz.fit_katz(own, deal)
    found = own.mapInArrow(katz._post_blocks(deal), katz.PACKED).groupBy("bucket").applyInArrow(katz._evaluate(deal, model), katz.OUT)
    sums = [katz.load(bytes(r.data)) for r in found.where("kind = 'sums'").collect()]
    assert 0 < sum(len(s[0]) for s in sums) <= 5 * len(rows)


def test_sums_by_document_are_those_of_dense_vectors():
    rng = np.random.default_rng(3)
    doc, x, n = rng.integers(0, 90, 300).astype(np.uint32), rng.normal(size=300), rng.integers(0, 3, 300)
    steps, sums, whole = katz._document_sums(doc, x, n)
    docs = np.cumsum(steps)
    dense, dense_n = np.bincount(doc, x, 90), np.bincount(doc, n, 90)
    assert np.array_equal(dense[docs], sums) and np.array_equal(dense_n[docs], whole) and not np.delete(dense, docs).any()
