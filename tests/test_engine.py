"""Behaviour of the engine's operators on small tables."""

import json
import math
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.functions import forms
from foliant.functions import text as tx
from foliant.operators import detect as dt
from foliant.operators import evaluate as ev
from foliant.operators import profile as pf
from foliant.operators import resolve as rs
from foliant.operators import select as sl
from foliant.operators import state as st
from foliant.plans import config as cf
from foliant.sources import records as rc
from foliant.sources import remote

PAPER = (
    "pmid string, title string, abstract string, journal string, pub_types array<string>, mesh array<string>, mesh_major array<string>,"
    " authors array<struct<last:string,fore:string,orcid:string,affiliation:string>>, language array<string>"
)


def one(spark, expr, **values):
    return spark.createDataFrame([Row(**values)]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "term", "hit"),
    [("taking part", "aki", False), ("the aki rate", "aki", True), ("éneonatal", "neonat*", True), ("x_neonatal", "neonat*", False), ("covid-19.", "covid-19", True), ("c++ code", "c++", True)],
)
def test_terms_stand_alone(spark, text, term, hit):
    assert one(spark, tx.term_hit(F.lower("t"), term), t=text) is hit


@pytest.mark.parametrize(("text", "n"), [("n = 1,234 and 56 patients", 1234), ("5 patients", None), ("We enrolled 120 adults", 120), ("n=2", None), ("", None)])
def test_sample_size(spark, text, n):
    assert one(spark, tx.sample_size(F.lit(""), F.col("t")), t=text) == n


def test_markup_and_entities(spark):
    got = one(spark, tx.clean_text(F.col("t")), t="  A <i>b</i>&#x41;&#233; &amp;lt;\n c&lt;d ")
    assert got == "A bAé &lt; c<d"
    assert one(spark, tx.partial_date(F.col("t")), t="<Year>2024</Year><Month>Mar</Month>") == "2024-03-01"
    assert one(spark, tx.partial_date(F.col("t")), t="<MedlineDate>2023 Nov-Dec</MedlineDate>") == "2023-11-01"


RECORD = """<PubmedArticle><PMID>7</PMID><Journal><ISOAbbreviation>Chest</ISOAbbreviation><JournalIssue><PubDate><Year>2024</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>On <i>sepsis</i></ArticleTitle><Abstract><AbstractText Label="AIM">Aim.</AbstractText><AbstractText>More.</AbstractText></Abstract>
<AuthorList><Author><LastName>Roe</LastName><ForeName>Ann</ForeName><Identifier Source="ORCID">https://orcid.org/0000-0001-0000-0001</Identifier>
<AffiliationInfo><Affiliation>X University</Affiliation></AffiliationInfo></Author></AuthorList><Language>eng</Language>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">Sepsis</DescriptorName></MeshHeading></MeshHeadingList>
<PubMedPubDate PubStatus="entrez"><Year>2024</Year><Month>5</Month><Day>6</Day></PubMedPubDate><ELocationID EIdType="doi">10.1/x</ELocationID></PubmedArticle>"""


def test_records(spark):
    texts = spark.createDataFrame([(RECORD + "<PubmedArticle><PMID>8</PMID></PubmedArticle>",)], "xml string")
    split = rc.split_records(texts)
    got = rc.parse_records(split).collect()
    assert len(got) == 1 and split.count() == 2
    r = got[0]
    assert (r.pmid, r.title, r.abstract, r.journal, r.doi, r.mesh_major) == ("7", "On sepsis", "AIM: Aim.\n\nMore.", "Chest", "10.1/x", ["Sepsis"])
    assert (r.edat, r.pubdate) == (date(2024, 5, 6), date(2024, 1, 1))
    assert r.authors[0] == Row(last="Roe", fore="Ann", orcid="0000-0001-0000-0001", affiliation="X University")


CONFIG = cf.Config(tiers=(("Chest.",), ("JAMA",), ("Shock",)), sections=(("A", cf.Terms(("Shock, Septic",), ("aki",))), ("B", cf.Terms((), ("sepsis",)))), gate=cf.Terms((), ("sepsis",)), hard_types=("Erratum",), soft_types=("Review",))


def judge(spark, **over):
    base = {"pmid": "1", "title": "Sepsis trial", "abstract": "", "journal": "chest", "pub_types": ["Journal Article"], "mesh": [], "mesh_major": [], "authors": [], "language": ["eng"]}
    df = spark.createDataFrame([{**base, **over}], PAPER)
    return sl.verdicts(dt.detect(sl.with_tier(df, sl.journal_tiers(spark, CONFIG)), CONFIG), CONFIG)


@pytest.mark.parametrize(
    ("over", "rule"),
    [
        ({}, None), ({"pub_types": ["Erratum"], "language": ["fre"]}, "hard_pt_exclude"), ({"language": ["fre"]}, "language"), ({"language": []}, None),
        ({"title": "COVID-19 waves"}, "suppress_covid_only"), ({"title": "Hernia repair today"}, "suppress_surgical_technique"), ({"title": "Prevalence of x"}, "epi"),
        ({"title": "Study protocol for sepsis"}, "protocol"), ({"pub_types": ["Review"], "journal": "Shock"}, "soft_exclude_non_tier12"),
        ({"pub_types": ["Letter"], "journal": "Other"}, "editorial_letter_non_tier12"), ({"pub_types": ["Letter"], "title": "x"}, "editorial_letter_failed_cc_gate"),
        ({"journal": "JAMA", "title": "Back pain"}, "cc_relevance_gate"), ({"journal": "Other"}, "journal_not_in_whitelist"),
    ],
)
def test_first_rule_wins(spark, over, rule):
    got = judge(spark, **over).first()["rule"]
    assert got == ("suppress_epi_only" if rule == "epi" else rule)


def test_sections_and_scores(spark):
    df = judge(spark, title="Septic shock and sepsis", abstract="aki", mesh=["Shock, Septic"])
    # A: heading 2 + abstract 1; B: title 3; the earlier section wins the tie.
    assert df.select(sl.section(CONFIG).alias("x")).first()["x"] == "A"
    assert one(spark, sl.study_score(F.array(F.lit("Letter"), F.lit("Meta-Analysis"))), t=1) == 0.9
    assert one(spark, sl.study_score(F.array(F.lit("Consensus Statement"))), t=1) == 0.6
    assert one(spark, sl.size_score(F.lit(None).cast("long"), F.lit(True)), t=1) == 0.4
    assert math.isclose(one(spark, sl.size_score(F.lit(1000), F.lit(False)), t=1), 0.6)


def plain_greedy(rows, cap, per, np_cap):
    out, sections, letters = [], {}, 0
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if len(out) >= cap:
            break
        if sections.get(r[2], 0) >= per or (r[3] and letters >= np_cap):
            continue
        letters += r[3]
        sections[r[2]] = sections.get(r[2], 0) + 1
        out.append(r[1])
    return out


def test_greedy_equals_walking_down(spark):
    import random

    rng = random.Random(3)
    rows = [(u, i, rng.choice("abcd"), rng.random() < 0.4, float(rng.randint(0, 9))) for u in range(12) for i in range(rng.randint(0, 60))]
    df = spark.createDataFrame(rows, "user_id long, item long, section string, non_primary boolean, score double")
    got = {}
    chosen = sl.greedy_digest(df, 9, 3, 2)
    for r in chosen.collect():
        got.setdefault(r.user_id, set()).add(r.item)
    for u in range(12):
        own = [r for r in rows if r[0] == u]
        assert got.get(u, set()) == set(plain_greedy(own, 9, 3, 2))
    left = sl.runners_up(df, chosen, 9).join(chosen.select("user_id", "item"), ["user_id", "item"]).count()
    assert left == 0


def test_profile_keeps_positives_and_bounds(spark):
    docs = spark.createDataFrame([(1, "Fluid therapy shock", "", ["Sepsis"], [])], "item long, title string, abstract string, mesh array<string>, mesh_major array<string>")
    v = pf.record_vectors(docs)
    assert {(r.term, r.n) for r in v.collect()} == {("fluid", 1), ("therapy", 1), ("shock", 1), ("fluid therapy", 1), ("therapy shock", 1), ("mesh:sepsis", 3)}
    old = spark.createDataFrame([(1, "positive", "old", 2.0)], "user_id long, polarity string, term string, weight double")
    none = spark.createDataFrame([], "user_id long, item long, tag string")
    assert pf.apply_feedback(old, none, v).first()["weight"] == 1.8
    tags = spark.createDataFrame([(1, 1, "tilde"), (1, 1, "skip")], "user_id long, item long, tag string")
    assert pf.apply_feedback(old, tags, v).where("polarity = 'negative'").count() == 6


def test_state(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, pos long")
    up = st.upsert(store, batch, "k", "pos")
    assert {tuple(r) for r in up.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in st.upsert(up, batch, "k", "pos").collect()} == {tuple(r) for r in up.collect()}
    assert [r.k for r in st.added(store, batch, "k").collect()] == [3]
    at = lambda d: datetime(2024, 1, d)
    seen = spark.createDataFrame([(1, 1, at(1)), (1, 2, at(2))], "user_id long, item long, seen_at timestamp")
    more = spark.createDataFrame([(1, 1, at(9)), (1, 3, at(3))], "user_id long, item long, seen_at timestamp")
    assert {r.item for r in st.mark_seen(seen, more, keep=2).collect()} == {2, 3}
    with pytest.raises(ValueError, match="no rows"):
        st.require_rows(store.limit(0), "store")


def test_resolution(spark):
    schema = "id long, name string, fore string, orcid string, aff string, journal string, coauthors array<string>"
    rows = [
        (1, "Doe", "Jane", "", "Dept, Yale University", "j", ["a", "b"]), (2, "Doe", "Jane", "", "Yale University; x", "k", []),
        (3, "Doe", "John", "", "Yale University", "j", ["a", "b"]), (4, "Doe", "J", "o1", "", "j", ["q"]), (5, "Doe", "J", "o1", "", "j", []), (6, "Doe", "J", "o2", "", "j", ["q", "r"]),
    ]
    r = spark.createDataFrame(rows, schema)
    label = rs.components(r.select("id"), rs.links(r))
    final = {x.id: x.cluster for x in rs.agglomerate(r, rs.split_contradictions(r, label)).collect()}
    assert final[1] == final[2] and final[4] == final[5] and len({final[1], final[3], final[4], final[6]}) == 4
    assert rs.summarise(r, rs.agglomerate(r, label.withColumnRenamed("component", "cluster"))).agg(F.sum("n").alias("n")).first()["n"] == 6
    q = rs.author_query(F.array(F.lit("o")), F.lit("Doe J"), F.array(F.lit("Yale"), F.lit("Yale University")), F.lit(True))
    assert one(spark, q, t=1) == '(o[auid] OR (Doe J[au] AND "Yale"[ad]))'


def test_archive_and_auc(spark):
    text = "## One\n### T1\nhttps://x.ncbi.nlm.nih.gov/11\n- **Tag:** [star]\n### T2\nncbi.nlm.nih.gov/12\n## Two\n### T3\nncbi.nlm.nih.gov/13\n**Tag:** [ ]"
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text.split("\n"))], "doc string, n int, line string")
    assert [(r.item, r.title, r.section, r.tag) for r in ev.parse_archive(lines).orderBy("ord").collect()] == [("11", "T1", "One", "star"), ("12", "T2", "One", ""), ("13", "T3", "Two", "")]
    s = spark.createDataFrame([(3.0, True), (1.0, True), (1.0, False), (2.0, False)], "score double, p boolean")
    assert ev.auc(s, F.col("p")).first()["auc"] == (1 + 1 + 0.5 + 0) / 4


def test_form(spark):
    body = "### Email address\n\na@b.co\n\n### Cadence\n\nWeekly\n\n### Specialty templates\n\n- [x] one\n- [ ] two\n\n### Journal tier\n\nall\n\n### Extra keywords\n\n_No response_\n\n### Author ORCID watch list\n\n0000-0001-0000-000x Ann\nbad\n"
    f = one(spark, forms.parse_form(F.col("b"), ["one", "two"]), b=body)
    assert (f.email, f.cadence, f.templates, f.journal_tier, f.extra_keywords) == ("a@b.co", "weekly", ["one"], "all", [])
    assert f.authors == [Row(orcid="0000-0001-0000-000X", label="Ann")] and len(f.errors) == 1
    assert len(one(spark, forms.parse_form(F.col("b"), ["one"]), b="").errors) == 4


def test_config(tmp_path):
    t = {"journals": {k: [f"{k}{i}"] for i, k in enumerate(cf.TIER_KEYS)}, "sections": {"A": {"mesh_terms": ["X"]}}, "scoring": {"topic_boosts": {"ecmo": 1.3}}}
    (tmp_path / "a.template.json").write_text(json.dumps(t))
    assert cf.list_templates(str(tmp_path)) == ["a"]
    with pytest.raises(ValueError, match="available: a"):
        cf.load_template(str(tmp_path), "b")
    assert len(cf.all_journals(cf.merge_templates([t, t], "tier12"))) == 2
    assert cf.from_template(t).sections == (("A", cf.Terms(("X",), ())),)
    assert cf.expand_types(["meta", "My Type", "zzz"]) == ["Meta-Analysis", "Systematic Review", "My Type"] and cf.unknown_types(["zzz"]) == ["zzz"]


def test_requests_retry_only_what_may_pass():
    calls, waits = [], []
    answers = iter([(503, ""), (429, ""), (200, "ok")])
    assert remote.request(lambda p, q: calls.append(p) or next(answers), "x", {}, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="404"):
        remote.request(lambda p, q: calls.append(p) or (404, ""), "x", {}, sleep=waits.append)
    assert len(calls) == 4
    found, failed = remote.search_authors(lambda p, q: (200, '{"esearchresult":{"idlist":["1"]}}'), ["0000-0001-0000-0001", "bad"])
    assert found == {"0000-0001-0000-0001": ["1"]} and list(failed) == ["bad"]
