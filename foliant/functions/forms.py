"""Sign-up forms rendered as markdown: sections under ### labels, check boxes, watch lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ORCID = r"^\d{4}-\d{4}-\d{4}-\d{3}[0-9X]$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
#: The labels of the form's fields, and what two of them may hold.
LABELS = {
    "email": "Email address", "cadence": "Cadence", "templates": "Specialty templates", "journal_tier": "Journal tier",
    "pub_types": "Publication types", "keywords": "Extra keywords", "authors": "Author ORCID watch list",
}
CADENCES, TIERS = ("weekly", "monthly"), ("tier1", "tier12", "all")


def section(body: Column, label: str) -> Column:
    """Text under a label; an unanswered field is empty."""
    got = F.regexp_extract(F.concat(body, F.lit("\n### ")), rf"(?s)(?:^|\n)###\s+{re.escape(label)}[ \t]*\r?(?:\n(.*?))?\n###\s", 1)
    t = F.regexp_replace(F.coalesce(got, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "_No response_", "").otherwise(t)


def checked(chunk: Column) -> Column:
    return F.regexp_extract_all(chunk, F.lit(r"(?m)^-[ \t]*\[[xX]\][ \t]*(\S.*?)[ \t\r]*$"), 1)


def parse_form(body: Column, templates: list[str]) -> Column:
    """struct of the form's fields and ``errors``, which is empty for a valid form."""
    f = {k: section(F.coalesce(body, F.lit("")), v) for k, v in LABELS.items()}
    cadence, tier = F.lower(f["cadence"]), F.lower(f["journal_tier"])
    picked = checked(f["templates"])
    lines = F.filter(F.transform(F.split(f["authors"], "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ids = F.transform(lines, lambda x: F.struct(F.upper(F.regexp_extract(x, r"^(\S+)", 1)).alias("orcid"), F.nullif(F.trim(F.regexp_replace(x, r"^\S+", "")), F.lit("")).alias("label")))
    quoted = lambda c, tail: F.concat(F.lit('"'), c, F.lit(f'"{tail}'))
    missing = lambda k: F.lit(f'Missing required field "{LABELS[k]}".')
    one = lambda k, v, ok: F.when(v == "", F.array(missing(k))).when(~v.isin(*ok), F.array(F.concat(F.lit(f"{LABELS[k]} "), quoted(v, f" must be one of: {', '.join(ok)}.")))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    errors = F.concat(
        F.when(f["email"] == "", F.array(missing("email"))).when(~f["email"].rlike(EMAIL), F.array(quoted(f["email"], " is not a valid email address."))).otherwise(none),
        one("cadence", cadence, CADENCES),
        F.when(F.size(picked) == 0, F.array(F.lit("Choose at least one specialty template."))).otherwise(none),
        F.transform(F.filter(picked, lambda t: ~t.isin(*templates)), lambda t: F.concat(F.lit("Unknown template "), quoted(t, f". Available: {', '.join(templates)}."))),
        one("journal_tier", tier, TIERS),
        F.transform(F.filter(ids, lambda a: ~a["orcid"].rlike(ORCID)), lambda a: quoted(a["orcid"], " is not a valid ORCID iD (expected 0000-0000-0000-000X).")),
    )
    keywords = F.filter(F.transform(F.split(f["keywords"], ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        f["email"].alias("email"), cadence.alias("cadence"), picked.alias("templates"), tier.alias("journal_tier"), checked(f["pub_types"]).alias("pub_types"),
        keywords.alias("extra_keywords"), F.filter(ids, lambda a: a["orcid"].rlike(ORCID)).alias("authors"), errors.alias("errors"),
    )
