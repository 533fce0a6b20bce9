"""Further queries: records with headings, authors and topical titles, made from documents by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import detect as dt
from foliant.operators import profile as pf
from foliant.operators import resolve as rs
from foliant.operators import select as sl
from foliant.operators import state as st
from foliant.plans.bindings import _INST, _TAG, _WORDS, CANDIDATES, CONFIG, ITEMS, PAPER, TYPES, _any_sql, _hit_sql, author_records, chosen_flagged, document_vectors, events, papers, query, table
from foliant.plans.config import Config, Terms
from foliant.tables import Scratch

TITLES = (
    "COVID-19 outcomes of ECMO", "covid in intensive care", "Covid19 in adults", "Study protocol for a trial of steroids", "Prevalence of asthma in schools", "Laparoscopic cholecystectomy in adults",
    "Wound closure and mortality", "Neonatal sepsis, a society guideline", "Machine learning in the ICU", "Capillary refill and shock", "Impedance tomography in children", "Position statement on fluids", "Plain letters",
)
HEADINGS = (("Infant, Newborn", "Shock, Septic"), ("COVID-19",), (), ("Child", "Extracorporeal Membrane Oxygenation"), ("Algorithms",), ("Critical Care", "COVID-19"))
PLACES = ("Society of Careful Medicine", "University of Elsewhere", None)
RICH = Config(
    tiers=CONFIG.tiers, general_scope=("src7",), hard_types=("Published Erratum",), soft_types=("Review",), societies=("Society of Careful Medicine",),
    sections=(("Shock", Terms(("Shock, Septic",), ("capillary refill",))), ("Support", Terms(("Extracorporeal Membrane Oxygenation",), ("ecmo", "steroids"))), ("Care", Terms(("Critical Care",), ("sepsis",)))),
    gate=Terms(("Critical Care",), ("icu", "intensive care", "shock")),
    topics={
        "ecmo": Terms(("Extracorporeal Membrane Oxygenation",), ("ecmo",)), "ventilation": Terms((), ("ventilat*",)), "informatics": Terms(("Algorithms",), ("machine learning",)),
        "hemodynamic": Terms((), ("capillary refill",)), "impedance": Terms((), ("impedance tomography",)),
    },
    factors={"ecmo": 1.3, "informatics_ai_in_cc": 1.5}, journal_factors={"src3": 0.75},
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: title, headings and authors by doc_id, the whole text as abstract."""
    pick = lambda values, kind: F.get(F.array(*values).cast(f"array<{kind}>"), (F.col("item") % len(values)).cast("int"))
    heads = [F.array(*map(F.lit, h)).cast("array<string>") for h in HEADINGS]
    person = lambda place: F.array(F.struct(F.lit("Doe").alias("last"), F.lit("J").alias("fore"), F.lit(None).cast("string").alias("orcid"), F.lit(place).cast("string").alias("affiliation")))
    mesh = pick(heads, "array<string>")
    return papers(spark, sf_dir).select(
        "item", pick([F.lit(x) for x in TITLES], "string").alias("title"), F.col("text").alias("abstract"), "journal", "language", "n_chars",
        F.when(F.col("item") % 29 == 0, F.array(F.lit("Clinical Trial Protocol"))).when(F.col("item") % 31 == 0, F.array(F.lit("Guideline"))).otherwise(F.col("pub_types")).alias("pub_types"),
        mesh.alias("mesh"), F.slice(mesh, 1, 1).alias("mesh_major"), pick([person(p) for p in PLACES], "array<struct<last:string,fore:string,orcid:string,affiliation:string>>").alias("authors"),
    )


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else _list(v) if isinstance(v, tuple) else f"'{v}'" for v in values) + "]"


_KIND = _list(TYPES)
RECORD = (
    f"record AS (SELECT doc_id AS item, {_list(TITLES)}[CAST(doc_id % {len(TITLES)} AS INT) + 1] AS title, text AS abstract, source AS journal, lang, n_chars,"
    f" CASE WHEN doc_id % 29 = 0 THEN 'Clinical Trial Protocol' WHEN doc_id % 31 = 0 THEN 'Guideline' ELSE {_KIND}[CAST(doc_id % 7 AS INT) + 1] END AS kind,"
    f" {_list(HEADINGS)}[CAST(doc_id % {len(HEADINGS)} AS INT) + 1] AS mesh, coalesce({_list(PLACES)}[CAST(doc_id % {len(PLACES)} AS INT) + 1], '') AS place,"
    " CASE WHEN TRY_CAST(substr(source, 4) AS INT) < 5 THEN 1 WHEN TRY_CAST(substr(source, 4) AS INT) < 10 THEN 2 WHEN TRY_CAST(substr(source, 4) AS INT) < 15 THEN 3 END AS tier FROM documents),"
    " low AS (SELECT *, lower(title || chr(10) || coalesce(abstract, '')) AS hay, lower(title) AS head, lower(place) AS spot, list_transform(mesh, lambda m: lower(m)) AS heads FROM record)"
)


def _heads(descriptors) -> str:
    return "(" + " OR ".join(f"list_contains(heads, '{d.lower()}')" for d in descriptors) + ")" if descriptors else "false"


def _either(t: Terms) -> str:
    said = [tx.descriptor_text(d) for d in t.headings] + list(t.text)
    return f"({_heads(t.headings)} OR {_any_sql('hay', tuple(said))})"


def _audit(column: str, terms) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {_hit_sql(column, t)} THEN '{t}' END" for t in terms) + ")"


_T = RICH.topics
SIGNALS = RECORD + (
    f", met AS (SELECT *, {_either(Terms(tuple(dt.PEDIATRIC_HEADINGS), tuple(dt.PEDIATRIC)))} AS pediatric, {_either(_T['ecmo'])} AS ecmo, {_any_sql('hay', _T['ventilation'].text)} AS ventilation,"
    f" {_any_sql('hay', RICH.societies)} OR {_any_sql('spot', RICH.societies)} OR {_any_sql('hay', tuple(dt.GUIDELINE))} AS society, {_either(_T['informatics'])} AS informatics,"
    f" {_any_sql('hay', _T['hemodynamic'].text)} AS hemodynamic, {_any_sql('hay', _T['impedance'].text)} AS impedance, {_either(RICH.gate)} AS cc_relevance, {_any_sql('head', tuple(dt.COVID))} AS _covid,"
    f" {_any_sql('hay', tuple(dt.SURGICAL))} AND NOT {_any_sql('hay', tuple(dt.OUTCOMES))} AS surgical_technique,"
    f" {_any_sql('head', tuple(dt.PROTOCOL))} OR kind = 'Clinical Trial Protocol' AS protocol, {_any_sql('head', tuple(dt.EPIDEMIOLOGY))} AND NOT {_any_sql('hay', tuple(dt.IMPLICATIONS))} AS _epi FROM low),"
    " signal AS (SELECT *, _covid AND NOT ecmo AND NOT impedance AND NOT ventilation AS covid_only, _epi AND NOT cc_relevance AS epi_only FROM met)"
)
_COVID_AUDIT = "concat_ws('|', " + ", ".join(f"CASE WHEN list_contains(heads, '{d.lower()}') THEN '{d}' END" for d in dt.COVID_HEADINGS) + ", " + ", ".join(f"CASE WHEN {_hit_sql('hay', t)} THEN '{t}' END" for t in dt.COVID) + ")"


@query(
    f"WITH {SIGNALS} SELECT item, {', '.join(dt.SIGNALS)}, CASE WHEN covid_only THEN {_COVID_AUDIT} ELSE '' END AS covid_terms, CASE WHEN surgical_technique THEN {_audit('hay', dt.SURGICAL)} ELSE '' END AS surgical_terms,"
    f" concat_ws('|', {', '.join(f'CASE WHEN {_hit_sql("head", t)} THEN {chr(39)}{t}{chr(39)} END' for t in dt.PROTOCOL)}, CASE WHEN kind = 'Clinical Trial Protocol' THEN 'pt:Clinical Trial Protocol' END) AS protocol_terms FROM signal"
)
def detect_all(spark, sf_dir):
    d = dt.detect(records(spark, sf_dir), RICH)
    said = lambda n: F.array_join(F.coalesce(F.try_element_at("matched", F.lit(n)), F.array().cast("array<string>")), "|")
    return d.select("item", *[f"signals.{s}" for s in dt.SIGNALS], said("covid_only").alias("covid_terms"), said("surgical_technique").alias("surgical_terms"), said("protocol").alias("protocol_terms"))


RULES = SIGNALS + (
    ", judged AS (SELECT *, CASE WHEN kind = 'Published Erratum' THEN 'hard_pt_exclude' WHEN lang = 'fr' THEN 'language' WHEN covid_only AND kind <> 'Guideline' THEN 'suppress_covid_only'"
    " WHEN surgical_technique THEN 'suppress_surgical_technique' WHEN epi_only THEN 'suppress_epi_only' WHEN protocol THEN 'protocol'"
    " WHEN kind = 'Review' AND coalesce(tier, 9) > 2 THEN 'soft_exclude_non_tier12' WHEN kind IN ('Editorial', 'Letter') AND coalesce(tier, 9) > 2 THEN 'editorial_letter_non_tier12'"
    " WHEN kind IN ('Editorial', 'Letter') AND NOT cc_relevance THEN 'editorial_letter_failed_cc_gate' WHEN (coalesce(tier, 9) = 3 OR journal = 'src7') AND NOT cc_relevance THEN 'cc_relevance_gate'"
    " WHEN tier IS NULL THEN 'journal_not_in_whitelist' END AS rule FROM signal)"
)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sl.with_tier(records(spark, sf_dir), sl.journal_tiers(spark, RICH))
    return sl.verdicts(dt.detect(r, RICH), RICH)


@query(f"WITH {RULES} SELECT item, rule FROM judged")
def filter_all_rules(spark, sf_dir):
    return judged(spark, sf_dir).select("item", "rule")


def _points(c: Config) -> dict[str, str]:
    out = {}
    for name, terms in c.sections:
        parts = []
        for d in terms.headings:
            t = tx.descriptor_text(d)
            parts.append(f"CASE WHEN lower(mesh[1]) = '{d.lower()}' THEN 3 WHEN list_contains(heads, '{d.lower()}') THEN 2 WHEN {_hit_sql('head', t)} THEN 3 WHEN {_hit_sql('lower(abstract)', t)} THEN 1 ELSE 0 END")
        parts += [f"CASE WHEN {_hit_sql('head', t)} THEN 3 WHEN {_hit_sql('lower(abstract)', t)} THEN 1 ELSE 0 END" for t in terms.text]
        out[name] = " + ".join(parts)
    return out


_P = {k: f"coalesce({v}, 0)" for k, v in _points(RICH).items()}
_BEST = "CASE WHEN greatest(a, b, c) = 0 THEN 'Misc' WHEN a >= b AND a >= c THEN 'Shock' WHEN b >= c THEN 'Support' ELSE 'Care' END"
SECTIONED = f", pointed AS (SELECT *, {_P['Shock']} AS a, {_P['Support']} AS b, {_P['Care']} AS c FROM judged), placed AS (SELECT *, {_BEST} AS section FROM pointed)"


@query(f"WITH {RULES}{SECTIONED} SELECT item, section FROM placed")
def heading_sections(spark, sf_dir):
    return records(spark, sf_dir).select("item", sl.section(RICH).alias("section"))


_FACTORS = (
    "CASE WHEN journal = 'src3' THEN 0.75 ELSE 1.0 END::DOUBLE * CASE WHEN pediatric THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN ecmo THEN 1.3 ELSE 1.0 END::DOUBLE * CASE WHEN ventilation THEN 1.3 ELSE 1.0 END::DOUBLE"
    " * CASE WHEN society THEN 1.4 ELSE 1.0 END::DOUBLE * CASE WHEN informatics THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN hemodynamic THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN impedance THEN 1.3 ELSE 1.0 END::DOUBLE"
    f" * CASE WHEN {_hit_sql('hay', 'steroids')} THEN 1.25 ELSE 1.0 END::DOUBLE"
)
_STUDY = "CASE kind WHEN 'Randomized Controlled Trial' THEN 1.0 WHEN 'Guideline' THEN 1.0 WHEN 'Meta-Analysis' THEN 0.9 WHEN 'Editorial' THEN 0.3 WHEN 'Letter' THEN 0.35 WHEN 'Review' THEN 0.5 ELSE 0.6 END::DOUBLE"
_CHOICE = ("Meta-Analysis", "Randomized Controlled Trial", "Guideline", "Letter")


@query(
    f"WITH {RULES}{SECTIONED}, w AS (SELECT DISTINCT {ITEMS} AS item, true AS is_watched FROM events WHERE event_type = 'error' AND value > 100)"
    f" SELECT item, coalesce(is_watched, false) AS is_watched, section, round((0.4 * CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.5 END + 0.3 * {_STUDY} + 0.2 * 0.5 + 0.1 * CASE WHEN pediatric THEN 0.4 ELSE 0.3 END)::DOUBLE * {_FACTORS}, 6) AS score"
    f" FROM placed LEFT JOIN w USING (item) WHERE is_watched OR (rule IS NULL AND kind IN {_CHOICE})"
)
def watched_scores(spark, sf_dir):
    """Scores of what passes or is by a followed author; texts state no enrolment here, so sizes are unknown."""
    watched = events(spark, sf_dir).where("event_type = 'error' and value > 100").select("item")
    no_size = judged(spark, sf_dir).withColumn("signals", F.col("signals").withField("sample_size", F.lit(None).cast("bigint")))
    s = sl.scored_papers(no_size, watched, F.lit(0.5), RICH, list(_CHOICE), dt.keyword_hits([" steroids "]))
    return s.select("item", "is_watched", "section", F.round("score", 6).alias("score"))


_HEAD_TERMS = f"SELECT item AS doc_id, 'mesh:' || lower(unnest(mesh)) AS term, 3 AS n FROM record UNION ALL SELECT item, 'mesh:' || lower(mesh[1]), 2 FROM record WHERE len(mesh) > 0"


@query(f"WITH {RECORD}, {_WORDS.replace('FROM documents', 'FROM (SELECT item AS doc_id, title || chr(32) || coalesce(abstract, chr(32)) AS text FROM record)')}, v AS (SELECT doc_id, term, n FROM c UNION ALL {_HEAD_TERMS}) SELECT doc_id AS item, term, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY ALL")
def record_vectors(spark, sf_dir):
    return pf.record_vectors(records(spark, sf_dir)).select("item", "term", "n")


@query(f"WITH {_WORDS}, live AS (SELECT term, CAST(sum(n) AS DOUBLE) AS w FROM c JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1), gold AS (SELECT term, CAST(2 * sum(n) AS DOUBLE) AS w FROM c JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) SELECT term, sum(w) AS weight FROM (SELECT * FROM live UNION ALL SELECT * FROM gold) GROUP BY 1")
def profile_floor(spark, sf_dir):
    scratch, labels = Scratch(spark, "floor"), table(spark, sf_dir, "labels")
    v = pf.unfolded(document_vectors(spark, sf_dir, labels).join(labels, "doc_id"), "quality", "toxic")
    # Both profiles' weights of a term in one pass.
    of = lambda where, k: F.sum(F.when(F.expr(where), F.col("n") * k)).cast("double")
    both = scratch.keep(v.groupBy("term").agg(of("quality = 1", 1).alias("live"), of("toxic = 1", 2).alias("gold")))
    scratch.leave(both)
    one = lambda c: both.where(F.col(c).isNotNull()).select(F.lit(0).alias("user_id"), F.lit("positive").alias("polarity"), "term", F.col(c).alias("weight"))
    return pf.with_floor(one("live"), one("gold")).select("term", "weight")


@query("WITH t AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS term, o_custkey % 3 + 1 AS weight FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey AS user_id, coalesce(term, 'template') AS term, coalesce(weight, 5)::DOUBLE AS weight FROM customer LEFT JOIN t ON user_id = c_custkey")
def profile_override(spark, sf_dir):
    """A stored profile stands in for the template's."""
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.lit("positive").alias("polarity"), F.col("o_orderpriority").alias("term"), (F.col("o_custkey") % 3 + 1).cast("double").alias("weight")).distinct()
    default = spark.createDataFrame([("positive", "template", 5.0)], "polarity string, term string, weight double")
    return pf.stored_or_default(stored, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), default).select("user_id", "term", "weight")


@query("SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS term FROM customer")
def profile_store(spark, sf_dir):
    """Saved profiles replace those of their users alone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    one = lambda df, term: df.select("user_id", F.lit("positive").alias("polarity"), F.lit(term).alias("term"), F.lit(1.0).alias("weight"))
    stored = st.save_profile(one(c, "old"), one(c.where("c_nationkey % 2 = 0"), "new"))
    return st.load_profile(stored, c).select("user_id", "term")


@query(f"SELECT user_id, {ITEMS} AS item, {_TAG} AS tag FROM events")
def feedback_log(spark, sf_dir):
    """A log of all events, appended in two parts and read in order of time."""
    tag = F.when(F.col("event_id") % 3 == 0, "star").when(F.col("event_id") % 3 == 1, "tilde").otherwise("skip")
    e = events(spark, sf_dir).select("user_id", "item", tag.alias("tag"), F.col("ts").alias("at"), "event_id")
    log = st.add_feedback(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1"))
    return st.load_feedback(log).select("user_id", "item", "tag")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 AND o > 0 THEN o END AS verified_at FROM (SELECT c_custkey, c_nationkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) AS o, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0) AS gone FROM customer) WHERE gone = 0 OR c_nationkey % 3 > 0")
def confirm_and_unsubscribe(spark, sf_dir):
    """Clicks with the right token confirm once or unsubscribe; others (nations 1 and 2 of 3) do nothing."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("bigint").alias("verified_at"), F.concat(F.lit("t"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_custkey")).otherwise(-1)).alias("unsub_token"))
    clicks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("t"), "o_custkey").alias("token"), F.col("o_orderkey").alias("at"))
    confirmed = st.confirm(users, clicks.where("at % 2 = 0"))
    return st.unsubscribe(confirmed, clicks.where("at % 7 = 0")).select("id", "verified_at")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 1000)")
def paged_scan(spark, sf_dir):
    """The second page of orders by key, and the exact count of all."""
    o = table(spark, sf_dir, "orders")
    first = st.page(o, "o_orderkey", None).agg(F.max("o_orderkey").alias("k"))
    after = first.first()["k"]
    return st.page(o, "o_orderkey", F.lit(after)).select("o_orderkey").crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("total"))))


@query(CANDIDATES + ", w AS (SELECT user_id, item FROM chosen UNION SELECT 7, item FROM chosen WHERE user_id = 3) SELECT user_id, item FROM w")
def shown_ledger(spark, sf_dir):
    """What a digest showed goes to the ledger: chosen rows, and (here) user 3's as user 7's author block."""
    chosen = chosen_flagged(spark, sf_dir).select("user_id", "item")
    block = chosen.where("user_id = 3").withColumn("user_id", F.lit(7).cast("long"))
    seen = sl.shown(chosen, block, F.lit("2024-02-01").cast("timestamp"))
    return st.mark_seen(seen.limit(0), seen).select("user_id", "item")


_WHO = "CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'id-' || s_suppkey % 7 ELSE 'Followed author' END"


@query(f"WITH b AS (SELECT l_orderkey AS user_id, l_linenumber AS rank, {_WHO} AS who, s_suppkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), g AS (SELECT user_id, who, min(rank) AS f, string_agg(item::VARCHAR, ',' ORDER BY rank, item) AS items FROM b GROUP BY ALL) SELECT user_id, who, row_number() OVER (PARTITION BY user_id ORDER BY f, who) AS place, items FROM g")
def author_grouping(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    watches = s.select(k.alias("item"), F.when(k % 3 == 0, F.col("s_name")).alias("label"), F.when(k % 3 == 1, F.concat(F.lit("id-"), k % 7)).otherwise("").alias("orcid"))
    block = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("user_id"), F.col("l_suppkey").alias("item"), F.lit(1.0).alias("score"), F.col("l_linenumber").alias("rank"))
    found = sl.author_groups(block, watches)
    return found.select("user_id", "who", F.col("place").cast("long").alias("place"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"WITH {PAPER} SELECT item, kind AS study, 'Digest: ' || strftime(DATE '2024-03-10' - INTERVAL 7 DAY, '%b %-d') || ' – ' || strftime(DATE '2024-03-10', '%b %-d, %Y') || ' (' || n_chars || ' kept)' AS quiet FROM paper")
def subject_lines(spark, sf_dir):
    label = tx.date_range(F.lit("2024-03-10").cast("date"), 7)
    return papers(spark, sf_dir).select("item", tx.primary_type(F.col("pub_types")).alias("study"), tx.subject_line("Digest", F.lit(0), label, F.col("n_chars")).alias("quiet"))


_TOKENS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: w <> '')"
_SAME = f"(a <> '' AND b <> '' AND (a = b OR len(list_intersect({_TOKENS.format('a')}, {_TOKENS.format('b')}))::DOUBLE / least(len({_TOKENS.format('a')}), len({_TOKENS.format('b')})) >= 0.67))"


@query(f"WITH s AS (SELECT x.p_partkey AS k, lower(x.p_name) AS a, lower(y.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1) SELECT k, {_SAME} AS same FROM s")
def same_institutions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("a"))
    pairs = p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    return pairs.select("k", rs.same_institution(F.col("a"), F.col("b")).alias("same"))


_RECORDS = (
    "li AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey::VARCHAR)) AS co, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1),"
    " r AS (SELECT id, co, CASE WHEN id % 3 = 0 THEN 'j' WHEN s_suppkey % 2 = 0 THEN 'jane' ELSE 'john' END AS f, CASE WHEN id % 11 = 0 THEN lpad(s_suppkey::VARCHAR, 4, '0') ELSE '' END AS orcid,"
    f" 'j' || id % 4 AS journal, {_INST} AS inst FROM li JOIN supplier USING (s_suppkey) JOIN nation ON s_nationkey = n_nationkey),"
    " p AS (SELECT x.id AS a_id, y.id AS b_id, x.inst AS a, y.inst AS b, x.f AS fa, y.f AS fb, x.orcid AS oa, y.orcid AS ob, x.journal = y.journal AS journal,"
    " len(list_intersect(x.co, y.co))::DOUBLE / least(len(x.co), len(y.co)) AS overlap, len(x.f) = 1 OR len(y.f) = 1 AS one FROM r x JOIN r y ON y.id > x.id AND y.id - x.id <= 8),"
    f" q AS (SELECT *, {_SAME} AS inst, NOT one AND fa = fb AS fore, NOT ((oa <> '' AND ob <> '' AND oa <> ob) OR (NOT one AND fa <> fb) OR (one AND fa[1] <> fb[1])) AS compatible FROM p),"
    " s AS (SELECT *, 0.62 * least(1, 2 * overlap) + 0.22 * inst::INT + 0.11 * fore::INT + 0.05 * journal::INT AS s FROM q)"
)


@query(f"WITH {_RECORDS} SELECT a_id, b_id, compatible, round(CASE WHEN NOT compatible THEN 0 WHEN oa <> '' AND oa = ob THEN 1 ELSE least(1, CASE WHEN fore AND inst THEN greatest(s, 0.85) ELSE s END) END::DOUBLE, 9) AS similarity FROM s")
def record_similarity(spark, sf_dir):
    """Similarity of author records whose orders lie within eight of each other."""
    pairs = rs.neighbours(rs.prepared(author_records(spark, sf_dir)).select("id", "fore", "orcid", "inst", "journal", "co"), 8)
    return pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), rs.compatible().alias("compatible"), F.round(rs.similarity(), 9).alias("similarity"))
