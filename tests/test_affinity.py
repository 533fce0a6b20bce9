"""Affinity of clusters, tidy institutions, saved users and skipped rows against plain versions."""

import random
import re

from pyspark.sql import functions as F

from foliant.operators import resolve as rs
from foliant.operators import select as sl

PERSON = "struct<orcid:string,fore:string,co:array<string>,insts:array<string>,journals:array<string>>"


def token(fore):
    return re.split(r"[\s.]+", (fore or "").strip())[0].lower()


def same(a, b):
    x, y = set(a.split()), set(b.split())
    return bool(a and b) and (a == b or len(x & y) / min(len(x), len(y)) >= 0.67)


def affinity(a, b):
    if a["orcid"] and b["orcid"]:
        return float(a["orcid"] == b["orcid"])
    fa, fb = token(a["fore"]), token(b["fore"])
    full = len(fa) > 1 and len(fb) > 1
    if (full and fa != fb) or (fa and fb and fa[0] != fb[0]):
        return 0.0
    shared = len(set(a["co"]) & set(b["co"]))
    s = {0: 0.0, 1: 0.28, 2: 0.42}.get(shared, 0.55) + 0.28 * any(same(x, y) for x in a["insts"] for y in b["insts"])
    return min(1.0, s + 0.18 * (full and fa == fb) + 0.08 * bool(set(a["journals"]) & set(b["journals"])))


def test_affinity_equals_plain(spark):
    rng = random.Random(3)
    person = lambda: {
        "orcid": rng.choice(("", "", "1", "2")), "fore": rng.choice(("Jane", "Jane M.", "J", "John", "Anne-Marie", "")), "co": rng.sample("abcdef", rng.randrange(5)),
        "insts": rng.sample(["yale university", "yale hospital", "oxford university", "ward"], rng.randrange(3)), "journals": rng.sample(["j1", "j2", "j3"], rng.randrange(3)),
    }
    pairs = [(i, person(), person()) for i in range(400)]
    df = spark.createDataFrame(pairs, f"i int, a {PERSON}, b {PERSON}")
    got = {r.i: r.s for r in df.select("i", rs.affinity().alias("s")).collect()}
    assert all(abs(got[i] - affinity(a, b)) < 1e-12 for i, a, b in pairs)


def tidy(insts):
    kept = []
    for i in sorted({x.strip() for x in insts if x.strip() and len(x.strip().split(" ")) <= 6}, key=lambda x: (len(x), x)):
        if not any(set(k.lower().split(" ")) <= set(i.lower().split(" ")) for k in kept):
            kept.append(i)
    return kept[:4]


def test_tidy_institutions_equal_plain(spark):
    rng = random.Random(4)
    words = ["yale", "university", "hospital", "st", "louis", "ward", "Oxford"]
    rows = [(i, [" ".join(rng.sample(words, rng.randint(1, 7))) + rng.choice(("", " ")) for _ in range(rng.randrange(9))] + [""]) for i in range(150)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, insts array<string>").select("i", rs.tidy_institutions(F.col("insts")).alias("t")).collect()}
    assert all(got[i] == tidy(insts) for i, insts in rows)


def test_watched_and_rest_part_all_rows(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, False)], "item long, is_watched boolean")
    watched, rest = sl.watched_and_rest(df)
    assert [r["item"] for r in watched.collect()] == [1] and sorted(r["item"] for r in rest.collect()) == [2, 3]
