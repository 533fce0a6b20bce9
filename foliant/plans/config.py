"""Configuration resolved on the driver: templates, overrides, and what users narrow."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

#: Publication types behind the form's choices.
_TRIALS = ["Randomized Controlled Trial", "Clinical Trial", "Controlled Clinical Trial"]
_REVIEWS = ["Meta-Analysis", "Systematic Review"]
_GUIDES = ["Practice Guideline", "Guideline", "Consensus Development Conference"]
TYPE_GROUPS = {
    "rct": _TRIALS, "meta": _REVIEWS, "meta-analysis": _REVIEWS, "meta-analysis-systematic-review": _REVIEWS, "systematic-review": _REVIEWS,
    "observational": ["Observational Study", "Multicenter Study", "Comparative Study", "Journal Article"], "guideline": _GUIDES, "practice-guideline": _GUIDES,
}
#: Scores of study types, the best listed one counting.
STUDY_SCORES = {
    "Randomized Controlled Trial": 1.0, "Practice Guideline": 1.0, "Guideline": 1.0, "Meta-Analysis": 0.9, "Systematic Review": 0.9,
    "Multicenter Study": 0.8, "Observational Study": 0.8, "Clinical Trial": 0.8, "Validation Study": 0.5, "Review": 0.5, "Letter": 0.35,
    "Editorial": 0.30, "Case Reports": 0.30,
}
#: Journals of general scope, gated like the third tier.
GENERAL_SCOPE = (
    "Cochrane Database Syst Rev", "N Engl J Med", "JAMA", "Lancet", "BMJ", "Nat Med", "JAMA Intern Med", "JAMA Pediatr", "Ann Intern Med", "JAMA Netw Open",
)


@dataclass(frozen=True)
class Terms:
    headings: tuple[str, ...] = ()
    text: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """Everything scoring and selection read; sections keep their order."""

    tiers: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]] = ((), (), ())
    sections: tuple[tuple[str, Terms], ...] = ()
    gate: Terms = Terms()
    hard_types: tuple[str, ...] = ()
    soft_types: tuple[str, ...] = ()
    #: Topics that lift a score, in the order their factors are multiplied.
    topics: dict[str, Terms] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=dict)
    journal_factors: dict[str, float] = field(default_factory=dict)
    societies: tuple[str, ...] = ()
    study_scores: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)
    tier_scores: tuple[float, float, float] = (1.0, 0.8, 0.5)
    general_scope: tuple[str, ...] = GENERAL_SCOPE
    hard_cap: int = 25
    per_section: int = 5
    non_primary: int = 4
    borderline: int = 3
    profile: dict = field(default_factory=dict)


def list_templates(folder: str) -> list[str]:
    return sorted(p.name.removesuffix(".template.json") for p in Path(folder).glob("*.template.json"))


def load_template(folder: str, slug: str) -> dict:
    known = list_templates(folder)
    if slug not in known:
        raise ValueError(f"unknown template {slug!r}; available: {', '.join(known)}")
    return json.loads((Path(folder) / f"{slug}.template.json").read_text())


def with_overrides(base: dict, over: dict | None) -> dict:
    """Lists and scalars replace; objects merge one level deep."""
    merged = {k: {**base[k], **v} if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in (over or {}).items()}
    return {**base, **merged}


TIER_KEYS = ("tier_1_primary_cc", "tier_2_top_general_plus_adjacent", "tier_3_cc_relevance_gate")


def all_journals(template: dict) -> list[str]:
    return [j for k in TIER_KEYS for j in template["journals"].get(k, [])]


def expand_types(keys: list[str]) -> list[str]:
    """Groups become their types, what looks like a type stays, the rest goes."""
    return list(dict.fromkeys(t for k in keys for t in TYPE_GROUPS.get(k, [k] if _raw_type(k) else [])))


def unknown_types(keys: list[str]) -> list[str]:
    return [k for k in keys if k not in TYPE_GROUPS and not _raw_type(k)]


def _raw_type(key: str) -> bool:
    return any("A" <= c <= "Z" for c in key) and any(c.isspace() for c in key)


def merge_templates(templates: list[dict], journal_tier: str = "all") -> dict:
    """The first is the base; later ones widen journals and sections; then tiers are narrowed."""
    base = dict(templates[0])
    for t in templates[1:]:
        base["journals"] = {**base["journals"], **{k: list(dict.fromkeys(base["journals"].get(k, []) + t["journals"].get(k, []))) for k in TIER_KEYS}}
        base["sections"] = {**base.get("sections", {}), **t.get("sections", {})}
    cut = {"tier1": TIER_KEYS[1:], "tier12": TIER_KEYS[2:]}.get(journal_tier, ())
    return {**base, "journals": {**base["journals"], **{k: [] for k in cut}}} if cut else base


def from_template(t: dict) -> Config:
    """Reads a template's JSON; notes and whatever scoring never reads are left out."""
    scoring, digest = t.get("scoring", {}), t.get("digest", {})
    boosts = scoring.get("topic_boosts", {})
    sections = t.get("sections", {})
    terms = lambda d: Terms(tuple(d.get("mesh_terms", d.get("mesh", []))), tuple(d.get("title_abstract_terms", d.get("ngrams", []))))
    gate = t.get("tier_3_cc_relevance_gate_criteria", {})
    factor = lambda v: v if isinstance(v, int | float) else v.get("multiplier", v.get("boost", 1.0)) if isinstance(v, dict) else 1.0
    w = scoring.get("weights", {})
    return Config(
        tiers=tuple(tuple(t["journals"].get(k, [])) for k in TIER_KEYS),
        sections=tuple((k, terms(v)) for k, v in sections.items()),
        gate=Terms(tuple(gate.get("mesh_terms_any_of", [])), tuple(gate.get("title_abstract_any_of", []))),
        hard_types=tuple(t.get("publication_types", {}).get("hard_exclude", [])),
        soft_types=tuple(t.get("publication_types", {}).get("soft_exclude_unless_tier_1_or_2", [])),
        topics={"ecmo": terms(sections.get("ECMO", {})), "ventilation": terms(sections.get("Respiratory_ARDS", {}))}
        | {k: terms(boosts.get(v, {})) for k, v in (("informatics", "informatics_ai_in_cc"), ("hemodynamic", "hemodynamic_perfusion_monitoring"), ("impedance", "eit_regional_ventilation")) if isinstance(boosts.get(v, {}), dict)},
        factors={k: float(factor(v)) for k, v in boosts.items() if not k.startswith("_")},
        journal_factors={k: float(v) for k, v in scoring.get("per_journal_score_override", {}).items() if not k.startswith("_")},
        societies=tuple(boosts.get("society_guideline", {}).get("societies", [])) if isinstance(boosts.get("society_guideline"), dict) else (),
        study_scores={k: float(v) for k, v in scoring.get("study_type_score", {}).items() if not k.startswith("_")},
        weights=(w.get("journal_tier", 0.4), w.get("study_type", 0.3), w.get("preference_match", 0.2), w.get("sample_size", 0.1)),
        hard_cap=digest.get("hard_cap", 25), per_section=digest.get("per_section_max", 5), non_primary=digest.get("max_non_primary_per_digest", 4),
        profile=t.get("preference_profile", {}).get("learned_profile", {}),
    )


def narrowed(c: Config, journal_tier: str) -> Config:
    keep = {"tier1": 1, "tier12": 2}.get(journal_tier, 3)
    return replace(c, tiers=tuple(t if i < keep else () for i, t in enumerate(c.tiers)))


def preferences(own: dict | None, template: str) -> dict:
    """A user's preferences over the defaults: one template, all tiers, nothing else chosen."""
    base = {"templates": [template], "journal_tier": "all", "pub_types": [], "extra_keywords": [], "authors": []}
    return {**base, **{k: v for k, v in (own or {}).items() if v is not None}}
