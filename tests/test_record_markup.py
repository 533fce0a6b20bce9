"""Marked-up records are read the same whatever the case of their tags, and cleaned whatever they hold."""

import re

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.sources import records as rc

RECORD = (
    '<PubmedArticle><PMID Version="1">7</PMID><Journal><ISOAbbreviation>J  X</ISOAbbreviation><JournalIssue><PubDate><Year>2020</Year><Month>Sep</Month><Day>3</Day></PubDate></JournalIssue></Journal>'
    '<ArticleTitle>On <I>x</I> &lt;Language&gt; &amp;lt; &#65;</ArticleTitle><Abstract><AbstractText Label="A">one  two</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName>'
    '<Identifier Source="ORCID">https://orcid.org/9</Identifier><AffiliationInfo><Affiliation> P </Affiliation></AffiliationInfo></Author></AuthorList>'
    '<PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">M</DescriptorName></MeshHeading></MeshHeadingList>'
    '<PubMedPubDate PubStatus="entrez"><Year>2020</Year><Month>12</Month><Day>1</Day></PubMedPubDate><ELocationID EIdType="doi">10.1/7</ELocationID><Language>eng</Language></PubmedArticle>'
)


def test_records_with_tags_in_any_case_are_read_alike(spark):
    turned = [RECORD, re.sub("</?[A-Za-z]+", lambda m: m[0].lower(), RECORD), re.sub("</?[A-Za-z]+", lambda m: m[0].upper(), RECORD)]
    got = rc.parse_records(rc.split_records(spark.createDataFrame([(t,) for t in turned], "xml string"))).collect()
    assert len(got) == 3 and got[0] == got[1] == got[2]
    assert got[0].title == "On x <Language> &lt; A" and got[0].abstract == "A: one two" and str(got[0].pubdate) == "2020-09-03" and str(got[0].edat) == "2020-12-01"
    assert got[0].mesh == got[0].mesh_major == ["M"] and got[0].authors[0].orcid == "9" and got[0].authors[0].affiliation == "P" and got[0].language == ["eng"]


def test_cleaning_leaves_nothing_out(spark):
    texts = ["plain", "two words", " lead", "trail ", "a  b", "a\tb", "a\nb\n", "a b", "﻿x", "<b>x</b>y", "&amp;lt;", "&#x41;&#66;", "", None, "AT&T", "a b ", "&#32;x"]
    want = ["plain", "two words", "lead", "trail", "a b", "a b", "a b", "a b", "x", "xy", "&lt;", "AB", "", None, "AT&T", "a b", "x"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.clean_text(F.col("t"))).collect()] == want


def test_marked_up_files_are_compressed_and_small_enough_for_many_tasks(spark, tmp_path):
    from foliant.plans import texts as pt

    spark.range(5000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("2020-03-04").cast("timestamp").alias("o_orderdate"),
    ).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    orders = pt.xml_orders(spark, str(tmp_path))
    rc.write_texts(orders, f"{tmp_path}/xml", lines=2000)
    size = sum(p.stat().st_size for p in tmp_path.glob("xml/part-*"))
    assert size * 10 < orders.agg(F.sum(F.length("value"))).first()[0] and len(list(tmp_path.glob("xml/part-*"))) == 3
    assert rc.framed_records(spark, f"{tmp_path}/xml").count() == 5000
    found = pt.xml_records(spark, str(tmp_path))
    assert all(f.endswith(".gz") for f in found.inputFiles())
    assert found.count() == sum(k % 7 > 0 for k in range(5000))
