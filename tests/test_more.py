"""Cases of the engine's operators that the bound queries don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import evaluate as ev
from foliant.operators import profile as pf
from foliant.operators import select as sl
from foliant.plans import config
from foliant.sources import remote


def test_references_to_no_character_stay(spark):
    rows = spark.createDataFrame([("&#9999999; &#65; &#xD800; &#x1F600; &#1114111;",)], "t string")
    assert rows.select(tx.decode_entities(F.col("t")).alias("t")).first()["t"] == "&#9999999; A &#xD800; \U0001f600 \U0010ffff"


def test_terms_hit_as_whole_words_or_stems(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(("an icu bed", "medicus", "neonatal icus", "post-icu", "", "sars-cov-2."))], "i int, t string")
    got = {r.i: r.h for r in rows.select("i", tx.term_hits(F.col("t"), ["ICU", "neonat*", "sars-cov-2"]).alias("h")).collect()}
    assert got == {0: ["ICU"], 1: [], 2: ["neonat*"], 3: ["ICU"], 4: [], 5: ["sars-cov-2"]}


def test_auc_over_many_ranges_equals_pairs(spark):
    rng = random.Random(1)
    rows = [(i % 2, rng.choice((rng.random(), round(rng.random(), 1))), rng.random() < 0.4) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, score double, p boolean")
    got = {r.g: r.auc for r in ev.auc(df, F.col("p"), ["g"], ranges=7).collect()}
    for g in (0, 1):
        pos, neg = ([s for x, s, p in rows if x == g and p == v] for v in (True, False))
        assert abs(got[g] - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12


def test_term_counts_and_matches_equal_plain(spark):
    docs = spark.createDataFrame([(1, "Lungs lungs hearts", None, ["Child"], ["Child"]), (2, "", "the and", None, None), (3, "kidneys", "lungs", [], [])], "item long, title string, abstract string, mesh array<string>, mesh_major array<string>")
    got = {(r["item"], r.term): r.n for r in pf.record_vectors(docs).collect()}
    assert got == {(1, "lungs"): 2, (1, "hearts"): 1, (1, "lungs lungs"): 1, (1, "lungs hearts"): 1, (1, "mesh:child"): 5, (3, "kidneys"): 1, (3, "lungs"): 1, (3, "kidneys lungs"): 1}
    profile = spark.createDataFrame([(7, "positive", "lungs", 2.0), (7, "negative", "kidneys", 1.0), (8, "positive", "hearts", 1.0)], "user_id long, polarity string, term string, weight double")
    for small in (True, False):
        rows = {(r.user_id, r["item"]): (r.positive, r.negative) for r in pf.matches(pf.term_counts(docs), profile, small=small).collect()}
        assert rows.keys() == {(7, 1), (7, 3), (8, 1)}
        assert rows[7, 3] == pytest.approx((1 / 3**0.5, 1 / 3**0.5)) and rows[7, 1] == pytest.approx((2 / 7**0.5, 0.0))


def test_digest_rows_agree_with_choice_and_runners_up(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.choice("AB"), rng.random() < 0.3, float(rng.randint(1, 9))) for u in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "user_id long, item long, section string, non_primary boolean, score double")
    all_rows = sl.digest_rows(df, 9, 4, 2, 3).collect()
    chosen = sl.greedy_digest(df, 9, 4, 2)
    assert {(r.user_id, r["item"]) for r in all_rows if r.chosen} == {(r.user_id, r["item"]) for r in chosen.collect()}
    assert {(r.user_id, r["item"], r["rank"]) for r in all_rows if not r.chosen} == {(r.user_id, r["item"], r["rank"]) for r in sl.runners_up(df, chosen, 9, 3).collect()}


def test_followed_authors_pass_and_are_grouped(spark):
    block = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)], "user_id long, item long, score double, rank int")
    watches = spark.createDataFrame([(10, "o1", "Ann"), (11, "o2", None), (12, "o1", "Ann")], "item long, orcid string, label string")
    assert [(r.who, r.place, r["items"]) for r in sl.author_groups(block, watches).orderBy("place").collect()] == [("Ann", 1, [10, 12]), ("o2", 2, [11])]
    assert config.preferences({"journal_tier": "tier1", "authors": None}, "a") == {"templates": ["a"], "journal_tier": "tier1", "pub_types": [], "extra_keywords": [], "authors": []}


def test_harvest_searches_and_fetches(spark, tmp_path):
    def transport(path, params):
        if path == "esearch":
            return 200, '{"esearchresult": {"idlist": ["1", "2", "3"]}}'
        return 200, f"<x>{params['id']}</x>"

    got = remote.harvest(spark, transport, ["J"], 7, parts=2, pace=0.0).collect()
    assert sorted(i for r in got for i in r.xml[3:-4].split(",")) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        remote.harvest(spark, transport, ["J"], 7, most=3)
    store = remote.Store(spark, str(tmp_path))
    store.append("t", spark.range(3))
    store.append("t", spark.range(2))
    assert store.count("t") == 5
