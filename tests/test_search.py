"""Full text and framed records against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import Observation

from foliant.operators import search as se
from foliant.sources import records as rc


def test_search_equals_scanning(spark, tmp_path):
    rng = random.Random(2)
    words = ["lung", "Heart", "shock", "é", "x1", "of", "the"]
    rows = [(i, "".join(rng.choice(words) + rng.choice((" ", ", ", "-")) for _ in range(rng.randrange(25)))) for i in range(200)] + [(900, None), (901, "")]
    se.write_index(spark.createDataFrame(rows, "item long, text string").repartition(3), str(tmp_path / "index"), buckets=5)
    queries = [(1, "and", "lung heart"), (2, "or", "x1 É"), (3, "phrase", "shock of the"), (4, "phrase", "the the lung"), (5, "and", "absent lung"), (6, "or", "absent lung lung"), (7, "and", " - "), (8, "phrase", "heart")]
    got = {(r.query, r["item"]): r.score for r in se.search(se.read_index(spark, str(tmp_path / "index")), spark.createDataFrame(queries, "query int, mode string, text string")).collect()}
    cut = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    want = {}
    for q, mode, text in queries:
        terms = re.findall(r"[^\W_]+", text.lower())
        for i, said in cut.items():
            side = any(said[k : k + len(terms)] == terms for k in range(len(said)))
            if terms and {"and": all(t in said for t in terms), "or": any(t in said for t in terms), "phrase": side}[mode]:
                want[q, i] = sum(said.count(t) * math.log(len(rows) / sum(t in s for s in cut.values()) + 1) for t in set(terms) if t in said)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def article(i, whole=True):
    day = "<Year>2024</Year><Month>Mar</Month><Day>5</Day>"
    return (
        f"<PubmedArticle x='1'><PMID>{i}</PMID><Journal><ISOAbbreviation>J</ISOAbbreviation><JournalIssue><PubDate>{day}</PubDate></JournalIssue></Journal>"
        f"<ArticleTitle>{'T &amp; ' + str(i) if whole else ''}</ArticleTitle><PubMedPubDate PubStatus=\"entrez\">{day}</PubMedPubDate>\n</PubmedArticle>\n"
    )


def test_framed_records_equal_whole_files_and_are_counted(spark, tmp_path):
    text = "<?xml version='1.0'?><PubmedArticleSet>" + "".join(article(i, i % 7 > 0) for i in range(3000)) + "</PubmedArticleSet>"
    (tmp_path / "a.xml").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        framed = rc.framed_records(spark, str(tmp_path / "a.xml"))
        assert framed.rdd.getNumPartitions() > 5
        whole = rc.split_records(spark.createDataFrame([(text,)], "xml string"))
        assert sorted(r.record for r in framed.collect()) == sorted(r.record for r in whole.collect())
        seen = Observation("read")
        parsed = rc.parse_records(framed, seen).collect()
        assert len(parsed) == 3000 - 429 and seen.get == {"records": 3000, "skipped": 429}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
