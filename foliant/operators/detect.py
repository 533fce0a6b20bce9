"""Signals of a record with the terms that caused them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import descriptor_text, haystack, heading_hits, sample_size, term_hits
from foliant.operators.terms import TermSet, among
from foliant.plans.config import Config, Terms
from foliant.tables import settled

#: The term lists behind the rules.
PEDIATRIC_HEADINGS = [
    "Infant", "Infant, Newborn", "Child", "Child, Preschool", "Adolescent", "Pediatrics", "Intensive Care Units, Pediatric",
    "Intensive Care Units, Neonatal", "Intensive Care, Neonatal", "Infant, Premature",
]
PEDIATRIC = [
    "pediatric", "paediatric", "children", "child", "neonat*", "infant*", "newborn", "adolescent*", "PICU", "NICU", "PCICU", "preterm",
    "premature infant", "school-age", "young people", "PARDS",
]
COVID = ["covid-19", "covid19", "covid", "sars-cov-2", "sars cov 2", "coronavirus disease 2019"]
COVID_HEADINGS = ["COVID-19", "SARS-CoV-2", "Coronavirus Infections"]
SURGICAL = [
    "surgical technique", "operative technique", "anastomosis", "laparoscop*", "arthroplasty", "fracture fixation", "cholecystectomy",
    "colorectal resection", "hernia repair", "valve repair", "valve replacement", "graft patency", "wound closure", "suture technique",
    "endoscopic resection", "robotic surgery", "incision",
]
OUTCOMES = [
    "icu", "intensive care", "critical care", "critically ill", "mortality", "ventilator", "mechanical ventilation", "vasopressor", "sepsis",
    "septic shock", "organ failure", "icu length of stay", "icu admission", "extracorporeal", "ecmo", "renal replacement", "shock",
]
EPIDEMIOLOGY = [
    "prevalence", "incidence trends", "national burden", "surveillance", "seroprevalence", "cross-sectional survey", "disease burden",
    "epidemiological trends", "population-based survey", "registry description", "health services utilization",
]
IMPLICATIONS = [
    "management", "treatment", "therapy", "intervention", "outcome", "mortality", "guideline", "protocol-directed", "bedside", "clinical decision",
    "triage", "practice",
]
PROTOCOL = [
    "study protocol", "trial protocol", "statistical analysis plan", "protocol for a randomized", "protocol for a randomised", "rationale and design",
    "design and rationale", "a protocol for",
]
GUIDELINE = ["consensus statement", "society guideline", "clinical practice guideline", "position statement"]

SIGNALS = (
    "pediatric", "ecmo", "ventilation", "society", "informatics", "hemodynamic", "impedance", "covid_only", "surgical_technique", "epi_only", "protocol", "cc_relevance",
)


def _headed(headings: str, hits: str, descriptors: list[str]) -> Column:
    """Descriptors among the headings, or said in the text, whose terms are in ``hits``."""
    if not descriptors:
        return F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(d.lower()).alias("low"), F.lit(descriptor_text(d)).alias("said")) for d in descriptors])
    return F.transform(F.filter(table, lambda e: F.array_contains(headings, e["low"]) | F.array_contains(hits, e["said"])), lambda e: e["d"])


def _terms(config: Config) -> list[str]:
    """What is looked for in the text: the rules' terms, a config's topics and gate, and how their headings read."""
    own = [Terms(tuple(PEDIATRIC_HEADINGS), tuple(PEDIATRIC)), config.gate, *config.topics.values()]
    said = [t for x in own for t in (*map(descriptor_text, x.headings), *x.text)]
    return [*said, *config.societies, *GUIDELINE, *COVID, *SURGICAL, *OUTCOMES, *IMPLICATIONS]


def detect(records: DataFrame, config: Config) -> DataFrame:
    """Adds ``signals`` (struct of booleans and sample_size) and ``matched`` (map of rule to terms).

    Expects title, abstract, mesh, pub_types and authors[].affiliation; null lists are empty.
    All terms of the rules and of the config are found in one pass over a text's tokens.
    """
    none = F.array().cast("array<string>")
    df = records.withColumns({
        "_text": haystack(F.col("title"), F.col("abstract")),
        "_title": F.lower(F.coalesce("title", F.lit(""))),
        "_mesh": F.transform(F.coalesce("mesh", none), F.lower),
        "_place": F.lower(F.array_join(F.transform(F.col("authors"), lambda a: F.coalesce(a["affiliation"], F.lit(""))), " ")),
    })
    df = TermSet(tuple(_terms(config))).find(df, "_text", "_in_text")
    df = TermSet((*COVID, *EPIDEMIOLOGY, *PROTOCOL)).find(df, "_title", "_in_title")
    df = TermSet(tuple(config.societies)).find(df, "_place", "_in_place")
    df = settled(df, "_in_text", "_in_title", "_in_place")
    in_text, in_title = lambda t: among("_in_text", t), lambda t: among("_in_title", t)
    either = lambda t: F.concat(_headed("_mesh", "_in_text", list(t.headings)), in_text(list(t.text)))
    topic = lambda k: either(config.topics[k]) if k in config.topics else none
    df = df.withColumns({
        "pediatric": either(Terms(tuple(PEDIATRIC_HEADINGS), tuple(PEDIATRIC))),
        "ecmo": topic("ecmo"), "ventilation": topic("ventilation"),
        "society": F.concat(in_text(list(config.societies)), among("_in_place", list(config.societies)), in_text(GUIDELINE)),
        "informatics": topic("informatics"), "hemodynamic": topic("hemodynamic"), "impedance": topic("impedance"),
        "cc_relevance": either(config.gate),
        "_covid": F.concat(heading_hits(F.col("_mesh"), COVID_HEADINGS), in_text(COVID)), "_covid_title": in_title(COVID),
        "_surgical": in_text(SURGICAL), "_outcome": in_text(OUTCOMES), "_epi": in_title(EPIDEMIOLOGY), "_implied": in_text(IMPLICATIONS),
        "protocol": F.concat(in_title(PROTOCOL), F.when(F.array_contains("pub_types", "Clinical Trial Protocol"), F.array(F.lit("pt:Clinical Trial Protocol"))).otherwise(none)),
    })
    some = lambda c: F.size(c) > 0
    only = lambda keep, c: F.when(keep, F.col(c)).otherwise(none)
    df = df.withColumns({
        "covid_only": only(some("_covid_title") & ~some("ecmo") & ~some("impedance") & ~some("ventilation"), "_covid"),
        "surgical_technique": only(~some("_outcome"), "_surgical"),
        "epi_only": only(~some("_implied") & ~some("cc_relevance"), "_epi"),
    })
    matched = F.map_filter(F.create_map(*[x for s in SIGNALS for x in (F.lit(s), F.col(s))]), lambda _, v: F.size(v) > 0)
    signals = F.struct(*[some(s).alias(s) for s in SIGNALS], sample_size(F.col("title"), F.col("abstract")).alias("sample_size"))
    return settled(df.select(*records.columns, signals.alias("signals"), matched.alias("matched")), "signals", "matched")


def keyword_hits(keywords: list[str]) -> Column:
    """A user's own terms in title or abstract; blank ones are none."""
    return term_hits(haystack(F.col("title"), F.col("abstract")), [k.strip() for k in keywords if k.strip()])


def type_choice(types: list[str]) -> Column:
    """True where a record has a chosen type, or nothing is chosen."""
    return F.coalesce(F.arrays_overlap("pub_types", F.array(*map(F.lit, types))), F.lit(False)) if types else F.lit(True)
