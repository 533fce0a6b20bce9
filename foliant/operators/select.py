"""Filter verdicts, scores, sections, and the constrained choice of a digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import descriptor_text, term_hit
from foliant.plans.config import STUDY_SCORES, Config

#: Types that count against the cap on other than primary research.
NON_PRIMARY = ("Editorial", "Letter", "Case Reports", "Review", "Comment")
GUIDELINES = ("Practice Guideline", "Guideline")


def has_type(types: tuple[str, ...] | list[str], column: str = "pub_types") -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, types)).cast("array<string>")), F.lit(False)) if types else F.lit(False)


def journal_tiers(spark: SparkSession, config: Config) -> DataFrame:
    """(journal_key, tier) of a config's journals, the first tier winning; at most as long as the config."""
    rows: dict[str, int] = {}
    for tier, names in enumerate(config.tiers, 1):
        for name in names:
            rows.setdefault(name.lower().removesuffix("."), tier)
    return spark.createDataFrame(list(rows.items()), "journal_key string, tier int")


def with_tier(records: DataFrame, tiers: DataFrame, journal: str = "journal") -> DataFrame:
    """Case and one trailing dot don't count; unlisted journals have a null tier."""
    keyed = records.withColumn("journal_key", F.regexp_replace(F.lower(journal), r"\.$", ""))
    return keyed.join(F.broadcast(tiers), "journal_key", "left").drop("journal_key")


def _verdict_rules(hard: Column, soft: Column, general: Column) -> list[tuple[str, Column, Column]]:
    """(rule, condition, detail) in order; lists of types and journals are array columns."""
    s = lambda n: F.col("signals")[n]
    said = lambda n: F.array_join(F.coalesce(F.col("matched")[n], F.array().cast("array<string>")), ", ")
    has = lambda types: F.coalesce(F.arrays_overlap("pub_types", types), F.lit(False))
    shared = lambda types: F.array_join(F.filter("pub_types", lambda t: F.array_contains(types, t)), ", ")
    top = F.coalesce(F.col("tier").isin(1, 2), F.lit(False))
    letter = has_type(("Editorial", "Letter"))
    no_evidence = F.lit("no CC relevance evidence")
    language = F.coalesce("language", F.array().cast("array<string>"))
    return [
        ("hard_pt_exclude", has(hard), shared(hard)),
        ("language", (F.size(language) > 0) & ~F.array_contains(language, "eng"), F.array_join(language, ",")),
        ("suppress_covid_only", s("covid_only") & ~has_type(GUIDELINES) & ~F.lower("journal").contains("cochrane"), said("covid_only")),
        ("suppress_surgical_technique", s("surgical_technique"), said("surgical_technique")),
        ("suppress_epi_only", s("epi_only"), said("epi_only")),
        ("protocol", s("protocol"), said("protocol")),
        ("soft_exclude_non_tier12", has(soft) & ~top, shared(soft)),
        ("editorial_letter_non_tier12", letter & ~top, F.array_join("pub_types", ", ")),
        ("editorial_letter_failed_cc_gate", letter & ~s("cc_relevance"), no_evidence),
        ("cc_relevance_gate", ((F.col("tier") == 3) | F.array_contains(general, F.col("journal"))) & ~s("cc_relevance"), F.concat("journal", F.lit(": "), no_evidence)),
        ("journal_not_in_whitelist", F.col("tier").isNull(), F.col("journal")),
    ]


def _first(rules: list[tuple[str, Column, Column]], pick) -> Column:
    met = lambda r: F.coalesce(r[1], F.lit(False))
    return reduce(lambda c, r: c.when(met(r), pick(r)), rules[1:], F.when(met(rules[0]), pick(rules[0])))


def first_rule(hard: Column, soft: Column, general: Column) -> Column:
    """Name of the first rule that rejects, null for kept.  Needs tier and signals."""
    return _first(_verdict_rules(hard, soft, general), lambda r: F.lit(r[0]))


def verdicts(df: DataFrame, config: Config) -> DataFrame:
    """Adds ``rule`` (first rule that rejects, null for kept) and ``detail``.  Needs tier, signals and matched."""
    rules = _verdict_rules(*[F.array(*map(F.lit, x)).cast("array<string>") for x in (config.hard_types, config.soft_types, config.general_scope)])
    return df.withColumns({"rule": _first(rules, lambda r: F.lit(r[0])), "detail": _first(rules, lambda r: r[2])})


def drop_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def study_score(types: Column, table: dict[str, float] | None = None) -> Column:
    """Best score among the listed types; without one, that of a plain article."""
    own = table or {}
    pairs = [x for t, d in STUDY_SCORES.items() for x in (F.lit(t), F.lit(float(own.get(t, d))))]
    scores = F.create_map(*pairs)
    best = F.array_max(F.filter(F.transform(types, lambda t: F.try_element_at(scores, t)), lambda v: v.isNotNull()))
    return F.coalesce(F.nullif(best, F.lit(0.0)), F.lit(float(own.get("Journal Article", 0.60))))


def size_score(n: Column, pediatric: Column) -> Column:
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.greatest(n.cast("double"), F.lit(10.0))) / 5))
    return F.when(n.isNull(), F.when(pediatric, 0.4).otherwise(0.3)).otherwise(F.when(pediatric, F.greatest(F.lit(0.4), scaled)).otherwise(scaled))


def base_score(tier: Column, study: Column, preference: Column, size: Column, config: Config) -> Column:
    a, b, c, d = config.weights
    one, two, three = config.tier_scores
    return F.lit(a) * F.when(tier == 1, one).when(tier == 2, two).otherwise(three) + F.lit(b) * study + F.lit(c) * preference + F.lit(d) * size


#: Factors of signals where a config names none, in the order they multiply.
FACTORS = {
    "pediatric": ("pediatric", 1.5), "ecmo": ("ecmo", 1.3), "ventilation": ("pards_or_mech_vent", 1.3), "society": ("society_guideline", 1.4),
    "informatics": ("informatics_ai_in_cc", 1.25), "hemodynamic": ("hemodynamic_perfusion_monitoring", 1.2), "impedance": ("eit_regional_ventilation", 1.3),
}


def boosts(config: Config, keywords: Column | None = None, keyword_factor: float = 1.25) -> Column:
    """map of factor names to factors."""
    own = config.journal_factors
    journal = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(v))]), F.col("journal")), F.lit(1.0)) if own else F.lit(1.0)
    out = [F.lit("journal_override"), journal]
    for s, (key, default) in FACTORS.items():
        out += [F.lit(s), F.when(F.col("signals")[s], float(config.factors.get(key, default))).otherwise(1.0)]
    if keywords is not None:
        out += [F.lit("keyword"), F.when(F.size(keywords) > 0, keyword_factor).otherwise(1.0)]
    return F.create_map(*out)


def boosted(base: Column, factors: Column) -> Column:
    return F.aggregate(F.map_values(factors), base, lambda acc, f: acc * f)


def practice_changing(tier: Column) -> Column:
    trial = F.array_contains("pub_types", "Randomized Controlled Trial") & (F.coalesce(F.col("signals")["sample_size"], F.lit(0)) >= 100) & (F.coalesce(tier, F.lit(3)) <= 2)
    return (has_type(GUIDELINES) & F.col("signals")["cc_relevance"]) | trial


def section_points(config: Config) -> list[tuple[str, Column]]:
    """Points of each section: a title states the topic (3), headings 3 or 2, the abstract 1."""
    title, abstract = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    none = F.array().cast("array<string>")
    major, mesh = (F.transform(F.coalesce(F.col(c), none), F.lower) for c in ("mesh_major", "mesh"))
    out = []
    for name, terms in config.sections:
        points = F.lit(0)
        for d in terms.headings:
            k, t = d.lower(), descriptor_text(d)
            points = points + F.when(F.array_contains(major, k), 3).when(F.array_contains(mesh, k), 2).when(term_hit(title, t), 3).when(term_hit(abstract, t), 1).otherwise(0)
        for t in terms.text:
            points = points + F.when(term_hit(title, t), 3).when(term_hit(abstract, t), 1).otherwise(0)
        out.append((name, points))
    return out


def section(config: Config) -> Column:
    """The section with most points, the earlier one in a tie; Misc without any."""
    points = section_points(config)
    if not points:
        return F.lit("Misc")
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, p) in enumerate(points)]))
    return F.when(best["p"] > 0, best["n"]).otherwise("Misc")


# --- digests


def candidate_order(score: str = "score", item: str = "item") -> list[Column]:
    return [F.col(score).desc(), F.col(item).asc()]


def digest_rows(scored: DataFrame, hard_cap: int | str = 25, per_section: int | str = 5, non_primary: int | str = 4, most: int | str = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, item, section, non_primary, score, *carry, chosen, rank) of chosen rows and the best others.

    Chosen is what walking down the scores takes under all caps; ``rank`` numbers a user's
    first ``most`` rows that were not chosen, null for chosen ones.  Caps are numbers, or
    names of columns that are the same in all rows of a user.  Rows that would meet a
    full section or a full class whatever came before are pruned by ranks first, but for the
    first hard_cap + most by score, among which the best others lie; so a user's fold, an
    array aggregation in the JVM, sees a few rows a section.
    """
    caps = {f"_cap{i}": F.col(c) if isinstance(c, str) else F.lit(c) for i, c in enumerate((hard_cap, per_section, non_primary, most))}
    hard_cap, per_section, letters_cap, most = map(F.col, caps)
    lane = W.partitionBy("user_id", "section", "non_primary").orderBy(*candidate_order())
    whole = W.partitionBy("user_id").orderBy(*candidate_order())
    ranked = scored.withColumns({**caps, "_r": F.row_number().over(lane), "_w": F.row_number().over(whole)})
    limit = F.when(F.col("non_primary"), F.least(per_section, letters_cap)).otherwise(per_section)
    few = ranked.where((F.col("_r") <= limit) | (F.col("_w") <= hard_cap + most))
    entry = F.struct((-F.col("score")).alias("down"), F.col("item"), F.col("section"), F.col("non_primary"), F.col("score"), (F.col("_w") <= hard_cap + most).alias("head"), *[F.col(c) for c in carry])
    lists = few.groupBy("user_id", *caps).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    kind = lists.schema["_all"].dataType

    def take(got: Column, x: Column) -> Column:
        here = F.size(F.filter(got, lambda y: y["section"] == x["section"]))
        letters = F.size(F.filter(got, lambda y: y["non_primary"]))
        fits = (F.size(got) < hard_cap) & (here < per_section) & (~x["non_primary"] | (letters < letters_cap))
        return F.when(fits, F.concat(got, F.array(x))).otherwise(got)

    folded = lists.select("user_id", *caps, "_all", F.aggregate("_all", F.array().cast(kind), take).alias("_got"))
    taken = F.transform("_got", lambda y: y["item"])
    others = F.slice(F.filter("_all", lambda y: y["head"] & ~F.array_contains(taken, y["item"])), F.lit(1), most)
    rows = F.concat(
        F.transform("_got", lambda y: F.struct(y.alias("x"), F.lit(None).cast("int").alias("rank"))), F.transform(others, lambda y, i: F.struct(y.alias("x"), (i + 1).cast("int").alias("rank")))
    )
    flat = folded.select("user_id", F.explode(rows).alias("r"))
    return flat.select("user_id", *[f"r.x.{c}" for c in ("item", "section", "non_primary", "score", *carry)], F.col("r.rank").isNull().alias("chosen"), "r.rank")


def greedy_digest(scored: DataFrame, hard_cap: int = 25, per_section: int = 5, non_primary: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """The chosen rows of ``digest_rows``."""
    return digest_rows(scored, hard_cap, per_section, non_primary, 0, carry).where("chosen").drop("chosen", "rank")


def runners_up(scored: DataFrame, chosen: DataFrame, hard_cap: int = 25, most: int = 3) -> DataFrame:
    """The best rows that were not chosen, where a choice is at hand; they lie within the first hard_cap + most by score."""
    w = W.partitionBy("user_id").orderBy(*candidate_order())
    head = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= hard_cap + most).drop("_r")
    left = head.join(chosen.select("user_id", "item"), ["user_id", "item"], "left_anti")
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def pins(chosen: DataFrame, most: int = 3) -> DataFrame:
    """The first practice-changing rows of a digest."""
    w = W.partitionBy("user_id").orderBy(*candidate_order())
    return chosen.where("practice_changing").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def section_lists(chosen: DataFrame, pinned: DataFrame, sections: list[str]) -> DataFrame:
    """(user_id, section_order, section, items) without pinned rows; empty sections don't occur."""
    order = {n: i for i, n in enumerate(dict.fromkeys([*sections, "Misc"]))}
    at = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))])
    left = chosen.join(pinned.select("user_id", "item"), ["user_id", "item"], "left_anti")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("item"))))
    return left.groupBy("user_id", "section").agg(F.transform(rows, lambda x: x["item"]).alias("items")).withColumn("section_order", F.try_element_at(at, F.col("section")))


def author_block(watched: DataFrame, most: int = 10) -> DataFrame:
    """A user's best rows by authors they follow."""
    w = W.partitionBy("user_id").orderBy(*candidate_order())
    return watched.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def scored_papers(judged: DataFrame, watched: DataFrame | None, preference: Column, config: Config, types: list[str] | None = None, keywords: Column | None = None) -> DataFrame:
    """Records with base, boosts, score, section and practice_changing, for those that pass or are watched.

    ``judged`` has verdicts; ``watched`` (item) lists records by followed authors, which pass
    the filter and the choice of types whatever they are.  Order of work: verdict, choice of
    types, base score, boosts (a user's keywords last), section.
    """
    df = judged.withColumn("is_watched", F.lit(False)) if watched is None else judged.join(watched.select("item").distinct().withColumn("_w", F.lit(True)), "item", "left").withColumn("is_watched", F.coalesce("_w", F.lit(False))).drop("_w")
    passes = F.col("is_watched") | (F.col("rule").isNull() & (has_type(types) if types else F.lit(True)))
    size = size_score(F.col("signals")["sample_size"], F.col("signals")["pediatric"])
    base = base_score(F.col("tier"), study_score(F.col("pub_types"), config.study_scores), preference, size, config)
    df = df.where(passes).withColumns({"base": base, "boosts": boosts(config, keywords)})
    return df.withColumns({"score": boosted(F.col("base"), F.col("boosts")), "section": section(config), "practice_changing": practice_changing(F.col("tier")), "non_primary": has_type(NON_PRIMARY)})


def watched_and_rest(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of followed authors, and all others, which alone compete for a digest."""
    return scored.where("is_watched"), scored.where("not is_watched")


def shown(chosen: DataFrame, author_rows: DataFrame, at: Column) -> DataFrame:
    """(user_id, item, seen_at) of what a sent digest showed: authors' rows, pins and sections; runners-up are not."""
    both = chosen.select("user_id", "item").unionByName(author_rows.select("user_id", "item")).distinct()
    return both.withColumn("seen_at", at)


def author_groups(block: DataFrame, watches: DataFrame) -> DataFrame:
    """(user_id, who, place, items): a user's author block under each author's label, else ORCID, in order of first row, then name.

    block: user_id, item, score, rank; watches: item, orcid, label, one row an item.
    """
    who = F.coalesce(F.nullif("label", F.lit("")), F.nullif("orcid", F.lit("")), F.lit("Followed author"))
    rows = F.sort_array(F.collect_list(F.struct("rank", "item")))
    grouped = block.join(watches, "item", "left").groupBy("user_id", who.alias("who")).agg(rows.alias("_rows"), F.min("rank").alias("_first"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("_first", "who"))
    return grouped.select("user_id", "who", place.alias("place"), F.transform("_rows", lambda x: x["item"]).alias("items"))
