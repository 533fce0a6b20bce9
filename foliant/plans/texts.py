"""Queries of marked-up records read from files, of full text, and of users' forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import search as se
from foliant.operators import select as sl
from foliant.operators import state as st
from foliant.plans.bindings import ITEMS, PAPER, SCORED, events, final, query, table
from foliant.sources import records as rc
from foliant.tables import Scratch


def xml_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a marked-up record, in column value; every seventh lacks its title."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = lambda f: F.date_format("o_orderdate", f)
    lit = F.lit
    published = (
        F.when(key % 3 == 0, F.concat(lit("<Year>"), day("yyyy"), lit("</Year><Month>"), day("MMM"), lit("</Month><Day>"), day("d"), lit("</Day>")))
        .when(key % 3 == 1, F.concat(lit("<MedlineDate>"), day("yyyy"), lit(" "), day("MMM"), lit("-Dec</MedlineDate>"))).otherwise(F.concat(lit("<Year>"), day("yyyy"), lit("</Year>")))
    )
    cust = F.col("o_custkey").cast("string")
    title = F.when(key % 7 > 0, F.concat(lit("<ArticleTitle>\n Order &lt;"), "o_orderstatus", lit("&gt; of <i>"), cust, lit("</i>  &amp;amp; &#169; co</ArticleTitle>"))).otherwise("<ArticleTitle/>")
    return o.select(F.concat(
        lit("<PubmedArticle><PMID Version='1'>"), key.cast("string"), lit("</PMID><Journal><ISOAbbreviation>J "), "o_orderpriority", lit("</ISOAbbreviation><JournalIssue><PubDate>"), published,
        lit("</PubDate></JournalIssue></Journal>"), title, lit('<Abstract><AbstractText Label="AIM">a  <b>b</b> '), cust, lit("</AbstractText><AbstractText>tail</AbstractText><AbstractText> </AbstractText></Abstract>"),
        lit("<AuthorList><Author><LastName>L"), cust, lit('</LastName><ForeName>F</ForeName><Identifier Source="ORCID">https://orcid.org/'), F.lpad(cust, 6, "0"),
        lit("</Identifier><AffiliationInfo><Affiliation>P1</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>P2 &quot;x&quot;</Affiliation></AffiliationInfo></Author>"),
        lit("<Author><CollectiveName>Group</CollectiveName></Author><Author></Author></AuthorList><PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>"), "o_orderstatus",
        lit('</PublicationType></PublicationTypeList><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">M '), "o_orderstatus",
        lit('</DescriptorName></MeshHeading><MeshHeading><DescriptorName MajorTopicYN="N">Child</DescriptorName></MeshHeading></MeshHeadingList><PubMedPubDate PubStatus="entrez"><Year>'),
        day("yyyy"), lit("</Year><Month>"), day("M"), lit("</Month><Day>"), day("d"), lit('</Day></PubMedPubDate><ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">10.1/'), key.cast("string"),
        lit("</ELocationID><Language>eng</Language></PubmedArticle>"),
    ).alias("value"))


@query(
    "SELECT o_orderkey::VARCHAR AS pmid, 'Order <' || o_orderstatus || '> of ' || o_custkey || ' &amp; © co' AS title, 'AIM: a b ' || o_custkey || chr(10) || chr(10) || 'tail' AS abstract, 'J ' || o_orderpriority AS journal,"
    " 'Review|' || o_orderstatus AS pub_types, 'M ' || o_orderstatus || '|Child' AS mesh, 'M ' || o_orderstatus AS mesh_major, 'L' || o_custkey || '/F/' || lpad(o_custkey::VARCHAR, 6, '0') || '/P1; P2 \"x\"|Group///' AS authors,"
    " CAST(o_orderdate AS DATE)::VARCHAR AS edat, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-01' ELSE strftime(o_orderdate, '%Y') || '-01-01' END AS pubdate,"
    " '10.1/' || o_orderkey AS doi, 'eng' AS language FROM orders WHERE o_orderkey % 7 > 0"
)
def xml_records(spark, sf_dir):
    """Orders written as marked-up files, read by closing tag and parsed."""
    scratch = Scratch(spark, "xml")
    rc.write_texts(xml_orders(spark, sf_dir), f"{scratch.at}/xml")
    found = rc.parse_records(rc.framed_records(spark, f"{scratch.at}/xml"))
    people = F.transform("authors", lambda a: F.concat_ws("/", a["last"], a["fore"], F.coalesce(a["orcid"], F.lit("")), F.coalesce(a["affiliation"], F.lit(""))))
    joined = {c: F.array_join(c, "|") for c in ("pub_types", "mesh", "mesh_major", "language")}
    return found.withColumns({**joined, "authors": F.array_join(people, "|"), "edat": F.col("edat").cast("string"), "pubdate": F.col("pubdate").cast("string")})


_ASKED = ((1, "and", "the that"), (2, "or", "ecmo, Token schule"), (3, "phrase", "of the"), (4, "phrase", "Is and"), (5, "and", "nowhere the"), (6, "or", "une la les"))
_WANTED = ", ".join(f"({q}, '{mode}', '{text.lower()}')" for q, mode, text in _ASKED)


@query(
    f"WITH d AS (SELECT doc_id AS item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM documents), q AS (SELECT query, mode, list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ts FROM (VALUES {_WANTED}) v(query, mode, t)),"
    " qt AS (SELECT DISTINCT unnest(ts) AS term FROM q), occ AS (SELECT item, term, count(*) AS tf FROM (SELECT item, unnest(ws) AS term FROM d) JOIN qt USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS n FROM occ GROUP BY 1),"
    " m AS (SELECT query, mode, ts, item, count(*) AS found, sum(tf * ln((SELECT count(*) FROM d)::DOUBLE / n + 1)) AS score FROM (SELECT query, mode, ts, unnest(list_distinct(ts)) AS term FROM q) JOIN occ USING (term) JOIN df USING (term) GROUP BY ALL)"
    " SELECT query, item, round(score, 6) AS score FROM m JOIN d USING (item) WHERE mode = 'or' OR (mode = 'and' AND found = len(list_distinct(ts))) OR (mode = 'phrase' AND strpos(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(ts, ' ') || ' ') > 0)"
)
def full_text_search(spark, sf_dir):
    """Words and phrases in all documents, by an index written first."""
    scratch = Scratch(spark, "search")
    se.write_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"), scratch.at)
    found = se.search(se.read_index(spark, scratch.at), spark.createDataFrame(list(_ASKED), "query int, mode string, text string"))
    return found.select("query", "item", F.round("score", 6).alias("score"))


@query(
    "WITH f AS (SELECT * FROM (SELECT 'C' || o_custkey || '@X' AS email, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1),"
    " u AS (SELECT c_custkey, 'c' || c_custkey || '@x' AS email FROM customer WHERE c_nationkey < 12)"
    " SELECT coalesce('u' || c_custkey, 'o' || o_orderkey) AS id, coalesce(f.email, u.email) AS email, coalesce('t' || c_custkey, 'n' || o_orderkey) AS unsub_token FROM u FULL JOIN f ON lower(f.email) = u.email"
)
def subscriptions(spark, sf_dir):
    """Forms of customers: known addresses keep id and token, whatever their letters' case."""
    c, o = table(spark, sf_dir, "customer").where("c_nationkey < 12"), table(spark, sf_dir, "orders")
    users = c.select(F.concat(F.lit("u"), "c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey", F.lit("@x")).alias("email"), F.lit(None).cast("timestamp").alias("verified_at"), F.concat(F.lit("t"), "c_custkey").alias("unsub_token"))
    last = st.latest(o.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    forms = last.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("C"), "o_custkey", F.lit("@X")).alias("email"), F.concat(F.lit("n"), "o_orderkey").alias("unsub_token"), F.col("o_orderdate").alias("at"))
    return st.subscribe(users, forms).select("id", "email", "unsub_token")


@query(
    f"WITH h AS (SELECT {ITEMS} AS item, user_id, event_id FROM events WHERE event_type = 'purchase'), s AS (SELECT {ITEMS} AS item FROM events WHERE event_type = 'view')"
    " SELECT item, user_id AS author FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY event_id DESC) AS r FROM h) WHERE r = 1 AND item NOT IN (SELECT item FROM s)"
)
def author_supplement(spark, sf_dir):
    """Items of followed authors that the sweep of viewed ones lacks; the last author of an item counts."""
    e = events(spark, sf_dir)
    hits = e.where("event_type = 'purchase'").select("item", F.col("user_id").alias("author"), F.col("event_id").alias("position"))
    return st.supplement(e.where("event_type = 'view'").select("item").distinct(), hits).select("item", "author")


@query(f"WITH {SCORED}, w AS (SELECT DISTINCT user_id, {ITEMS} AS item, event_type = 'error' AS e FROM events), m AS (SELECT user_id, item, bool_or(e) AS is_watched FROM w GROUP BY ALL) SELECT user_id, CASE WHEN is_watched THEN 'authors' ELSE 'rest' END AS side, count(*) AS n, round(sum(score), 6) AS total FROM m JOIN final USING (item) GROUP BY ALL")
def watched_partition(spark, sf_dir):
    """Each user's scored records by followed authors, and all others, apart."""
    own = events(spark, sf_dir).groupBy("user_id", "item").agg(F.max(F.col("event_type") == "error").alias("is_watched"))
    sides = sl.watched_and_rest(own.join(final(spark, sf_dir).select("item", "score"), "item"))
    sums = lambda df, side: df.groupBy("user_id", F.lit(side).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))
    return sums(sides[0], "authors").unionByName(sums(sides[1], "rest"))


@query(f"WITH {PAPER}, w AS (SELECT DISTINCT user_id, {ITEMS} AS item FROM events), f AS (SELECT * FROM (WITH {SCORED} SELECT item, score FROM final)) SELECT user_id, item, score, rank FROM (SELECT user_id, item, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM w JOIN f USING (item)) WHERE rank <= 10")
def author_blocks(spark, sf_dir):
    """Every user's best records among those they met."""
    watch = events(spark, sf_dir).select("item", "user_id").distinct()
    return sl.author_block(final(spark, sf_dir).select("item", "score").join(watch, "item")).select("user_id", "item", "score", F.col("rank").cast("long").alias("rank"))
