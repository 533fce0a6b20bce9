"""Term queries in one pass against every term and text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import terms as tm

WORDS = ["alpha", "beta", "covid", "19", "sars", "cov", "2", "neonat", "neonatal", "school", "age", "β", "x_neonat", "c++", "a.b", "$5", "PICU", "in", "of"]
TERMS = ["covid-19", "covid 19", "Neonat*", "school-age*", "β", "β-*", "c++", "A.B", "$5", "picu", "sars-cov-2", "*", "  ", "in", "2", "co*", "-19", "x_neonat", "alpha  beta", "al*", "s*", " of ", "missing"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "-", "\n", ", ", "_", ""]) for _ in range(n))
    return [(i, text(rng.randrange(4)), text(rng.randrange(30)) if i % 9 else None) for i in range(300)]


def hit(term, text):
    return re.search(tx.term_pattern(term), (text or "").lower()) is not None


@pytest.mark.parametrize("small", [1000, 0])
def test_term_matches_equal_every_pattern_on_every_text(spark, rows, small):
    df = spark.createDataFrame(rows, "item long, title string, abstract string").repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS] + [(None,), ("in",)], "term string")
    real = [t.strip() for t in TERMS if t.strip() not in ("", "*")]
    want = {(i, t, hit(t, a), hit(t, b)) for i, a, b in rows for t in real if hit(t, a) or hit(t, b)}
    got = tm.term_matches(df, terms, small=small).collect()
    assert len(got) == len(want) and {(r["item"], r.term, r.in_title, r.in_abstract) for r in got} == want
    assert tm.term_matches(df, terms.limit(0), small=small).count() == 0 and tm.term_matches(df.limit(0), terms, small=small).count() == 0


def test_term_sets_equal_every_pattern(spark, rows):
    real = tuple(t.strip() for t in TERMS if t.strip() not in ("", "*"))
    df = spark.createDataFrame(rows, "item long, title string, abstract string").withColumn("low", F.lower("abstract"))
    found = tm.TermSet(real).find(df, "low", "hits").select("item", "hits", tm.among("hits", ["PICU", "In", "neonat*", "in"]).alias("own")).collect()
    text = {i: b for i, _, b in rows}
    assert all(set(r.hits) == {t.lower() for t in real if hit(t, text[r["item"]])} for r in found)
    assert all(r.own == [t for t in ("PICU", "In", "neonat*", "in") if hit(t, text[r["item"]])] for r in found)


def test_rarest_token_is_the_key(spark):
    often = spark.createDataFrame([("intensive", 9), ("care", 50)], "token string, n long")
    index = {r.term: r.key for r in tm.term_index(spark.createDataFrame([("intensive care",), ("care of x1",), ("neonatolog*",), ("care in neo*",), ("β",)], "term string"), often).collect()}
    assert index == {"intensive care": "intensive", "care of x1": "of", "neonatolog*": "neon*", "care in neo*": "in", "β": "β"}
