"""Very many terms against very many texts, by what a text's tokens have in common with the terms.

A whole term can only hit a text that has each of its tokens, a ``stem*`` one that has a token
with its last token's beginning.  So each term waits under one key: a whole token where it has
one, else the first letters of its stem; a text is cut into tokens once, and only terms whose
key it has are looked at, with the same pattern as ``text.term_hit``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import term_pattern
from foliant.tables import Scratch

#: Letters and digits together, and any other visible character by itself.
TOKEN = r"[a-z0-9]+|[^a-z0-9\s]"
#: Letters of a stem's beginning that make a key.
PREFIX = 4
#: Terms whose index may be broadcast, with their keys in an expression; more are joined by shuffle.
SMALL_INDEX = 20_000


def _tokens(lowered: Column, marks: bool) -> Column:
    """Distinct tokens of a text; characters that are no letter or digit only where a term waits for one."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(TOKEN), 0) if marks else F.split(lowered, "[^a-z0-9]+"))


def _keys(tokens: Column, lengths: list[int]) -> Column:
    """Tokens, and their beginnings of the given lengths marked by a star."""
    parts = [F.transform(F.filter(tokens, lambda t: F.length(t) >= n), lambda t: F.concat(F.substring(t, 1, n), F.lit("*"))) for n in lengths]
    return F.array_distinct(F.concat(tokens, *parts)) if parts else tokens


def term_index(terms: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """(term, plain, pattern, key) of the distinct terms of ``terms`` (term); blank ones are none.

    ``often`` (token, n) says how many texts hold a token: a term waits under its rarest one,
    without it under its longest.  Characters that are no letters or digits are taken only by
    terms that have nothing else.
    """
    own = terms.select(F.trim("term").alias("term")).where("term is not null and term != ''").distinct()
    low = own.select("term", F.lower("term").alias("_low"))
    cut = low.select("term", "_low", F.col("_low").endswith("*").alias("_stem")).withColumn("plain", F.when(F.col("_stem"), F.expr("substring(_low, 1, length(_low) - 1)")).otherwise(F.col("_low"))).where("plain != ''")
    found = cut.withColumn("_t", F.regexp_extract_all("plain", F.lit(TOKEN), 0))
    # A stem that ends in a letter or digit may go on: its last token is a beginning only.
    open_end = F.col("_stem") & F.col("plain").rlike("[a-z0-9]$")
    whole = F.when(open_end, F.slice("_t", F.lit(1), F.size("_t") - 1)).otherwise(F.col("_t"))
    begun = F.when(open_end, F.concat(F.substring(F.element_at("_t", -1), 1, PREFIX), F.lit("*")))
    quoted = F.regexp_replace("plain", r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    pattern = F.when(F.col("_stem"), F.concat(F.lit("(?<![0-9a-z_])"), quoted)).otherwise(F.concat(F.lit("(?:^|[^a-z0-9])"), quoted, F.lit("(?:[^a-z0-9]|$)")))
    ready = found.select("term", "plain", pattern.alias("pattern"), whole.alias("_w"), begun.alias("_b"), "_t")
    letters = F.filter("_w", lambda t: t.rlike("^[a-z0-9]"))
    ready = ready.withColumn("_w", F.when(F.size(letters) > 0, letters).when(F.col("_b").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("_w")))
    if often is None:
        best = F.element_at(F.sort_array(F.transform("_w", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
        return ready.select("term", "plain", "pattern", F.when(F.size("_w") > 0, best).otherwise(F.col("_b")).alias("key")).where("key is not null")
    flat = ready.where(F.size("_w") > 0).select("term", F.explode("_w").alias("token")).join(often, "token", "left")
    rare = flat.groupBy("term").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("_k"))
    return ready.join(rare, "term", "left").select("term", "plain", "pattern", F.coalesce("_k", "_b").alias("key")).where("key is not null")


def _verified(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keeps rows (texts, plain, pattern) where the term hits a field; adds ``in_<field>``."""
    hit = lambda f: F.col(f"_x_{f}").contains(F.col("plain")) & F.regexp_like(f"_x_{f}", F.col("pattern"))
    marked = df.withColumns({f"in_{f}": F.coalesce(hit(f), F.lit(False)) for f in fields})
    return marked.where(" or ".join(f"in_{f}" for f in fields))


def term_matches(records: DataFrame, terms: DataFrame, key: str = "item", fields: tuple[str, ...] = ("title", "abstract"), small: int = SMALL_INDEX) -> DataFrame:
    """(key, term, in_<field>, ...): each record's terms, with the fields that each hits.

    ``records`` has one row a record, ``terms`` a column term, of which equal ones count once;
    letter case and blanks around a term don't count, blank and null terms are none, null texts
    are empty.  Up to ``small`` terms, counted, nothing is shuffled: their keys stand in an
    expression, which narrows a record's tokens before they become rows.  Beyond it tokens
    and keys meet in a join, each term under its rarest token, and texts are read again for
    the candidates alone.
    """
    scratch = Scratch(records.sparkSession, "terms")
    texts = records.select(key, *[F.lower(F.coalesce(f, F.lit(""))).alias(f"_x_{f}") for f in fields])
    out = [key, "term", *[f"in_{f}" for f in fields]]
    joined = F.concat_ws("\n", *[f"_x_{f}" for f in fields])
    index = scratch.keep(term_index(terms))
    about = index.agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.when(F.col("key").endswith("*") & (F.length("key") > 1), F.length("key") - 1))).alias("lengths"),
        F.coalesce(F.max(~F.col("key").rlike("^[a-z0-9]")), F.lit(False)).alias("marks"),
    ).first()
    tokens = texts.withColumn("_t", _tokens(joined, about["marks"])).withColumn("_k", _keys(F.col("_t"), about["lengths"])).drop("_t")
    if about["n"] <= small:
        waiting = F.lit([r["key"] for r in index.select("key").distinct().collect()]) if about["n"] else F.array().cast("array<string>")
        narrowed = tokens.withColumn("_k", F.array_intersect("_k", waiting)).withColumn("key", F.explode_outer("_k")).where("key is not null").drop("_k")
        scratch.leave(index)
        return _verified(narrowed.join(F.broadcast(index), "key"), list(fields)).select(*out)
    flat = tokens.select(key, F.explode_outer("_k").alias("token")).where("token is not null")
    known = index.select(F.explode(F.regexp_extract_all("plain", F.lit(TOKEN), 0)).alias("token")).distinct()
    often = scratch.keep(flat.join(known, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = scratch.keep(term_index(terms, often))
    met = scratch.keep(flat.join(rarest.withColumnRenamed("key", "token"), "token").drop("token"))
    scratch.leave(met)
    return _verified(met.join(texts, key), list(fields)).select(*out)


@dataclass(frozen=True)
class TermSet:
    """Terms known on the driver, matched inside an expression: the time of a text hardly depends on their number."""

    terms: tuple[str, ...]

    def _entries(self) -> list[tuple[str, str, str, str]]:
        import re

        out = {}
        for term in self.terms:
            low = term.lower()
            plain, stem = low.removesuffix("*"), low.endswith("*")
            found = re.findall(TOKEN, plain)
            begun = found.pop() if stem and found and re.search("[a-z0-9]$", plain) else None
            letters = [t for t in found if re.match("[a-z0-9]", t)]
            key = max(letters, key=len) if letters else begun[:PREFIX] + "*" if begun else found[0] if found else None
            if key is None:
                raise ValueError(f"a term without a visible character: {term!r}")
            out[low] = (low, plain, term_pattern(term), key)
        return list(out.values())

    def find(self, df: DataFrame, lowered: str, to: str) -> DataFrame:
        """Adds ``to``: the (lower-cased) terms that hit the text in column ``lowered``, without order."""
        entries = self._entries()
        none = F.array().cast("array<string>")
        if not entries:
            return df.withColumn(to, none)
        keys = [e[3] for e in entries]
        lengths = sorted({len(k) - 1 for k in keys if len(k) > 1 and k.endswith("*")})
        marks = any(not k[0].isascii() or not k[0].isalnum() for k in keys)
        cut = df.withColumn("_t", _tokens(F.coalesce(lowered, F.lit("")), marks)).withColumn("_k", F.array_intersect(_keys(F.col("_t"), lengths), F.lit(sorted(set(keys))))).drop("_t")
        table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("term", "plain", "pattern", "key"), strict=True)]) for e in entries])
        waiting = F.filter(table, lambda e: F.array_contains("_k", e["key"]))
        text = F.col(lowered)
        hit = F.filter(waiting, lambda e: text.contains(e["plain"]) & F.regexp_like(text, e["pattern"]))
        # (A column that only a lambda reads, once, would be put in its place and found anew for each element.)
        return cut.withColumn(to, F.when(F.size("_k") > 0, F.transform(hit, lambda e: e["term"])).otherwise(none)).drop("_k")


def among(hits: str, terms: list[str]) -> Column:
    """The terms of a list that are among a record's hits, in the list's order."""
    if not terms:
        return F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t.lower()).alias("low")) for t in terms])
    found = F.transform(F.filter(table, lambda e: F.array_contains(hits, e["low"])), lambda e: e["t"])
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<string>"))
