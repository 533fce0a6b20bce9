"""The pipeline's stages against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("foliant.llm")
import corpus_pipeline as cp  # noqa: E402
from foliant.llm.rules import quality_rules  # noqa: E402
from foliant.llm.toxicity import toxicity_scores  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    ws = [w for w in re.split("[ \t-\r]+", low(text)) if w]
    n = min(5, len(ws))
    return {" ".join(ws[p : p + n]) for p in range(len(ws) - n + 1)} if ws else set()


def firsts(texts):
    """The smallest id of each group of near copies."""
    own, label = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if a < b and both and 100 * both >= 80 * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d for d in texts if root(d) == d}


def contaminated(text, items):
    words = lambda t: [w for w in re.split(r"[\x00-/:-`{-\x7f]+", low(t)) if w]
    ws, hit = words(text), set()
    for item in map(words, items):
        n = min(13, len(item))
        windows = {tuple(item[p : p + n]) for p in range(len(item) - n + 1)} if n else set()
        for p in range(len(ws) - n + 1):
            if tuple(ws[p : p + n]) in windows:
                hit.update(range(p, p + n))
    return bool(hit) and 20 * len(hit) >= len(ws)


def test_toxic_documents_go_by_the_threshold_of_their_language(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", ("en", "de")[i % 2], "s", 6) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    score, cuts = F.col("doc_id") / 20.0, F.when(F.col("lang") == "en", 0.4).otherwise(0.9)
    judged = lambda d, labels: d.select("doc_id", (score >= 0.7).cast("int").alias("predicted"), (score >= cuts).alias("rejected"))
    monkeypatch.setattr(cp, "toxicity_scores", judged)
    got = {r.doc_id for r in cp.drop_toxic(spark, docs, SMALL).collect()}
    assert got == {i for i in range(20) if i / 20 < (0.9 if i % 2 else 0.4)}


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = [r.doc_id for r in quality_rules(docs).where("kept").collect()]
    docs = docs.where(F.col("doc_id").isin(good))
    clean = [r.doc_id for r in toxicity_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("not rejected").collect()]
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(clean)).collect()}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {d for d in firsts(texts) if not contaminated(texts[d], items)}
    assert sorted(r.doc_id for r in cp.run(spark, SMALL).select("doc_id").collect()) == sorted(want)


def words_cut(text, items):
    """The text's words outside all windows of the items."""
    words = lambda t: [w for w in re.split(r"[\x00-/:-`{-\x7f]+", low(t)) if w]
    ws, hit = words(text), set()
    for item in map(words, items):
        n = min(13, len(item))
        windows = {tuple(item[p : p + n]) for p in range(len(item) - n + 1)} if n else set()
        for p in range(len(ws) - n + 1):
            if tuple(ws[p : p + n]) in windows:
                hit.update(range(p, p + n))
    return [w for i, w in enumerate(ws) if i not in hit]


def test_columns_of_the_last_stages(spark):
    """Cut-out text, lengths, pieces and scores of what passes, beside documents with odd ids and columns."""
    words = lambda t: [w for w in re.split(r"[\x00-/:-`{-\x7f]+", low(t)) if w]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    passage = next(" ".join(words(t)[:14]) for t in items if len(words(t)) >= 14)
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [(1, f"{filler} {passage} tail"), (2, passage), (3, filler), (4, None), (5, ""), (6, f"{filler} again"), (6, f"{filler} again"), (None, filler)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, pieces string, score double"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", 0.5) for i, t in rows], schema)
    clean = cp.drop_benchmark(spark, docs, SMALL)
    assert clean.columns == list(cp.DOCUMENT)
    kept = sorted(clean.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in kept] == [None, 1, 3, 4, 5, 6, 6]
    assert words(kept[1].text) == words_cut(rows[0][1], items) and kept[1].n_chars == len(kept[1].text) < len(rows[0][1])
    assert kept[2].text == filler and kept[3].text is None and kept[3].n_chars == 0
    last = cp.to_pieces(spark, clean, SMALL)
    assert last.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "n_pieces", "scores"]
    for r in last.collect():
        text = next(k.text for k in kept if k.doc_id == r.doc_id)
        assert r.text == text and r.n_pieces == len(r.piece_ids) and (r.scores == sorted(r.scores, reverse=True)) and (len(r.scores) == 2 or not text)


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SMALL).collect() == [] and stage(spark, docs, SMALL).columns == list(cp.DOCUMENT)
    assert cp.to_pieces(spark, docs, SMALL).count() == 0
