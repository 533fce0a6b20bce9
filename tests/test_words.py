"""Words of profiles: the same as by cleaning and splitting, in one pass over the text."""

import re

from pyspark.sql import functions as F

from foliant.functions import text as tx

TEXTS = ["The Quick-brown fox, and its  DEN", "a bcd﻿efg　hij", "Kelvin straße x\x1cyyy\tzzz\nab abc --- -a- 0123", "İstanbul cafés", "", "  ", None]


def plain(text):
    lowered = text.replace("İ", "i̇").lower()
    kept = re.sub(r"[^a-z0-9 \t\n\x0b\f\r\- ]", " ", lowered)
    return [w for w in re.split("[ \t\n\x0b\f\r ]+", kept) if len(w) > 2 and w not in tx.STOPWORDS]


def test_words_equal_plain_and_take_one_pass(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").select("k", tx.words(F.col("text")).alias("w"))
    assert {r.k: r.w for r in df.collect()} == {k: t if t is None else plain(t) for k, t in enumerate(TEXTS)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan
