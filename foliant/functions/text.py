"""Scalar text expressions: term matching, markup, labels, hashes.  All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser's regular expressions see it (Java's \s is ASCII only).
SPACE = r"[\s ﻿  -     　]"
#: The words that profiles leave out.
STOPWORDS = [
    "the", "and", "for", "with", "was", "were", "that", "this", "from", "are", "has", "have", "not", "but", "all", "can", "who", "had", "его", "than",
    "then", "they", "their", "been", "after", "before", "during", "between", "among", "into", "over", "under", "more", "less", "study", "patients",
    "results", "methods", "conclusions", "background", "objective", "objectives", "using", "used", "compared", "associated",
]
#: Month names by their first three letters.
MONTHS = {m: f"{i:02d}" for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], 1)}
#: Joins names for a moment; no name holds it.
MARK = "\x01"


def _quoted(term: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", term)


def term_pattern(term: str) -> str:
    """Pattern over lower-cased text: whole terms stand between other characters, ``stem*`` starts at a word."""
    t = term.lower()
    if t.endswith("*"):
        return "(?<![0-9a-z_])" + _quoted(t[:-1])
    return f"(?:^|[^a-z0-9]){_quoted(t)}(?:[^a-z0-9]|$)"


def term_hit(lowered: Column, term: str) -> Column:
    """Plain text is looked for first: most texts lack most terms, and bytes are found much faster than patterns."""
    return lowered.contains(term.lower().removesuffix("*")) & lowered.rlike(term_pattern(term))


def named(marks: list[tuple[Column, str]]) -> Column:
    """array of the names whose condition holds, in order."""
    if not marks:
        return F.array().cast("array<string>")
    met = F.concat_ws(MARK, *[F.when(c, F.lit(n)) for c, n in marks])
    return F.when(met == "", F.array().cast("array<string>")).otherwise(F.split(met, MARK))


def term_hits(lowered: Column, terms: list[str]) -> Column:
    """The terms that hit, in the order given."""
    return named([(term_hit(lowered, t), t) for t in terms])


def descriptor_text(descriptor: str) -> str:
    """How an indexing heading reads in prose: up to its first comma."""
    return re.sub(r",.*$", "", descriptor.lower())


def heading_hits(headings: Column, descriptors: list[str]) -> Column:
    """Descriptors among the (lower-cased) headings."""
    return named([(F.array_contains(headings, d.lower()), d) for d in descriptors])


def heading_or_text_hits(headings: Column, lowered: Column, descriptors: list[str]) -> Column:
    """Descriptors among the headings, or said in the text."""
    return named([(F.array_contains(headings, d.lower()) | term_hit(lowered, descriptor_text(d)), d) for d in descriptors])


def haystack(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(abstract, F.lit(""))))


def sample_size(title: Column, abstract: Column) -> Column:
    """Largest plausible enrolment the abstract (or else the title) states; null if none."""
    text = F.when(F.coalesce(abstract, F.lit("")) != "", abstract).otherwise(F.coalesce(title, F.lit("")))
    # The phrasings that state an enrolment.
    patterns = (
        r"\b[nN]\s*=\s*([0-9][0-9,]{0,7})",
        r"(?i)\b([0-9][0-9,]{1,7})\s+(?:patients|children|infants|neonates|subjects|participants|admissions|episodes|cases)\b",
        r"(?i)\b(?:included|enrolled|analy[sz]ed|randomi[sz]ed)\s+([0-9][0-9,]{1,7})\b",
    )
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns])
    numbers = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"))
    return F.array_max(F.filter(numbers, lambda v: (v >= 3) & (v <= 50_000_000)))


def words(text: Column) -> Column:
    """Words over two letters long that are no stopwords, in order."""
    # White space of any kind and whatever else is neither letter, digit nor dash parts words, so one pass finds them.
    split = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9-]{3,}"), 0)
    return F.filter(split, lambda w: ~w.isin(STOPWORDS))


def ngrams(kept: Column) -> Column:
    """Single words and pairs of neighbours."""
    pairs = F.when(F.size(kept) > 1, F.zip_with(F.slice(kept, 1, F.size(kept) - 1), F.slice(kept, 2, F.size(kept) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(kept, F.coalesce(pairs, F.array().cast("array<string>")))


# --- markup


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is found once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(c), f), 0)


def _tagged(tag: str, group: str = "?:") -> str:
    return rf"(?s)<(?i:{tag})({group}\s[^>]*)?>(.*?)</(?i:{tag})>"


def element(text: Column, tag: str) -> Column:
    """Content of the first <tag>; empty if there is none."""
    return F.regexp_extract(text, _tagged(tag), 1)


def contents(text: Column, tag: str) -> Column:
    """Content of every <tag>."""
    return F.regexp_extract_all(text, F.lit(_tagged(tag)), 1)


def elements(text: Column, tag: str) -> Column:
    """array<struct<attrs, content>> of every <tag>: one pass over the text, then over what it found."""
    pattern = _tagged(tag, "")
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("attrs"), F.regexp_extract(m, pattern, 2).alias("content")))


def attribute(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf'(?i){name}\s*=\s*"([^"]*)"', 1)


def decode_entities(text: Column) -> Column:
    """Named and numeric references; the ampersand last, so that nothing is decoded twice."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), named.items(), text)

    def numeric(c: Column, pattern: str, base: int) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 1))
        code = lambda x: F.conv(x, base, 10).cast("bigint")
        prefix = "&#x" if base == 16 else "&#"
        # What is no character (beyond the last code point, half a surrogate pair) stays as it is written.
        valid = lambda x: (code(x) <= 0x10FFFF) & ~code(x).between(0xD800, 0xDFFF)
        char = lambda x: F.when(valid(x), F.decode(F.unhex(F.lpad(F.hex(F.when(valid(x), code(x)).otherwise(32)), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit(prefix), x, F.lit(";")))
        return bound(refs, lambda found: F.aggregate(found, c, lambda acc, x: F.replace(acc, F.concat(F.lit(prefix), x, F.lit(";")), char(x))))

    both = lambda t: bound(numeric(t, r"&#x([0-9a-fA-F]{1,6});", 16), lambda c: numeric(c, r"&#([0-9]{1,7});", 10))
    out = bound(out, lambda c: F.when(c.contains("&#"), both(c)).otherwise(c))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


#: What cleaning changes: tags, references, white space that is no single blank between others.
UNCLEAN = SPACE.replace(r"[\s", r"[<&\t\n\x0B\f\r", 1) + "| (?: |$)|^ "


def clean_text(text: Column) -> Column:
    """Tags out, references decoded, white space collapsed and trimmed."""

    def clean(t: Column) -> Column:
        bare = F.regexp_replace(t, r"<[^>]*>", "")
        plain = bound(bare, lambda c: F.when(c.contains("&"), decode_entities(c)).otherwise(c))
        return F.regexp_replace(F.regexp_replace(plain, SPACE + "+", " "), "^ | $", "")

    return bound(text, lambda t: F.when(t.rlike(UNCLEAN), clean(t)).otherwise(t))


def month_number(text: Column) -> Column:
    """Two digits of a month's number or name; 01 for anything else."""
    numbers = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    named = lambda t: F.coalesce(F.try_element_at(numbers, F.lower(F.substring(t, 1, 3))), F.lit("01"))
    return bound(F.trim(text), lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t.try_cast("int").cast("string"), 2, "0")).otherwise(named(t)))


def partial_date(block: Column) -> Column:
    """YYYY-MM-DD of a marked-up date; missing parts are 01, no year gives the empty string."""
    part = lambda b, tag: clean_text(element(b, tag))

    def dated(b: Column) -> Column:
        month = bound(part(b, "Month"), lambda m: F.when(m != "", month_number(m)).otherwise("01"))
        day = bound(part(b, "Day"), lambda d: F.when(d.rlike(r"^\d+$"), F.lpad(d, 2, "0")).otherwise("01"))
        return bound(part(b, "Year"), lambda y: F.when(y.rlike(r"^\d{4}$"), F.concat_ws("-", y, month, day)).otherwise(_loose_date(part(b, "MedlineDate"))))

    return bound(block, dated)


def _loose_date(free: Column) -> Column:
    def dated(text: Column) -> Column:
        name = F.regexp_extract(text, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", 1)
        year = F.regexp_extract(text, r"\b(\d{4})\b", 1)
        return bound(year, lambda y: F.when(y != "", F.concat_ws("-", y, month_number(name), F.lit("01"))).otherwise(""))

    return bound(free, dated)


# --- presentation


def escape_html(text: Column) -> Column:
    pairs = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), F.coalesce(text, F.lit("")))


def snippet(text: Column, most: int = 220) -> Column:
    """At most ``most`` characters, cut at the last space beyond the fortieth, with an ellipsis."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    head = F.substring(t, 1, most)
    back = F.locate(" ", F.reverse(head))
    last = F.when(back > 0, F.lit(most) - back).otherwise(-1)
    safe = F.when(last > 40, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(safe, f"{SPACE}+$", ""), F.lit("…")))


def pretty_section(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def primary_type(types: Column) -> Column:
    """First type but the generic one, else the first, else a fallback."""
    notable = F.filter(types, lambda t: t != "Journal Article")
    return F.coalesce(F.get(notable, 0), F.get(types, 0), F.lit("Study"))


def date_range(end: Column, days: Column | int) -> Column:
    start = F.date_sub(end, days)
    same = F.year(start) == F.year(end)
    return F.concat(F.date_format(start, "MMM d"), F.when(same, "").otherwise(F.concat(F.lit(", "), F.date_format(start, "yyyy"))), F.lit(" – "), F.date_format(end, "MMM d, yyyy"))


def subject_line(title: str, pinned: Column, range_label: Column, kept: Column) -> Column:
    return F.concat(F.when(pinned > 0, "⚡ ").otherwise(""), F.lit(f"{title}: "), range_label, F.lit(" ("), kept.cast("string"), F.lit(" kept)"))


def weekday(user_id: Column) -> Column:
    """0 to 6 from a polynomial hash of the id modulo 2**32."""
    codes = F.filter(F.split(user_id, ""), lambda c: c != "")
    return (F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)) % F.lit(4294967296)) % 7).cast("int")


def link(base: str, **params: Column) -> Column:
    """URL with its query; values are encoded."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(F.coalesce(v.cast("string"), F.lit("")))) for k, v in params.items()]
    return F.concat(F.lit(base.rstrip("/") + "/action.html?"), F.concat_ws("&", *parts))
