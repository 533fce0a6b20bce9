"""Bibliographic records from marked-up text, and files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import attribute, bound, clean_text, contents, element, elements, partial_date
from foliant.tables import settled

FULL_DATE = r"^\d{4}-\d{2}-\d{2}$"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines of JSON under a declared schema; a corrupt line fails the read instead of vanishing."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


#: Lines of a text file; compressed ones are read by one task each.
FILE_LINES = 50_000


def write_texts(texts: DataFrame, path: str, lines: int = FILE_LINES) -> None:
    """Column ``value`` as lines of compressed files of at most ``lines`` each, which many tasks can read.

    Marked-up text is some twenty times smaller so; as it stands it would outgrow its source many times.
    """
    texts.select("value").write.option("compression", "gzip").option("maxRecordsPerFile", lines).text(path)


def split_records(texts: DataFrame, column: str = "xml", tag: str = "PubmedArticle") -> DataFrame:
    """One row a record element."""
    return texts.select(F.explode(F.regexp_extract_all(column, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)).alias("record"))


def framed_records(spark: SparkSession, path: str, tag: str = "PubmedArticle") -> DataFrame:
    """One row a record element of text files, cut at the closing tag as they are read, so that one large file is read by many tasks.

    Rows are the same as those of ``split_records`` on whole files, if closing tags are
    written as ``tag`` is; what follows the last one is no record.
    """
    frames = spark.read.option("lineSep", f"</{tag}>").text(path)
    opened = rf"(?is)<{tag}(?:\s[^>]*)?>(.*)$"
    return settled(frames.where(F.col("value").rlike(opened)).select(F.regexp_extract("value", opened, 1).alias("record")), "record")


def _first_full(items: Column) -> Column:
    return F.coalesce(F.get(F.filter(items, lambda x: x != ""), 0), F.lit(""))


def _authors(record: Column) -> Column:
    full = lambda last, otherwise: bound(last, lambda x: F.when(x != "", x).otherwise(otherwise))

    def one(body: Column) -> Column:
        last = full(clean_text(element(body, "LastName")), clean_text(element(body, "CollectiveName")))
        places = F.filter(F.transform(contents(body, "AffiliationInfo"), lambda i: clean_text(element(i, "Affiliation"))), lambda x: x != "")
        ids = F.filter(elements(body, "Identifier"), lambda i: F.upper(attribute(i["attrs"], "Source")) == "ORCID")
        orcid = F.regexp_replace(clean_text(F.get(ids, 0)["content"]), r"(?i)^https?://orcid\.org/", "")
        return F.struct(
            last.alias("last"), clean_text(element(body, "ForeName")).alias("fore"),
            full(orcid, F.lit(None)).alias("orcid"), full(F.array_join(places, "; "), F.lit(None)).alias("affiliation"),
        )

    people = F.transform(contents(element(record, "AuthorList"), "Author"), one)
    return F.filter(people, lambda p: (p["last"] != "") | (p["fore"] != ""))


def parse_records(records: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Typed records; those without id, title, journal or both full dates are left out.

    ``seen`` counts ``records`` and ``skipped`` in the pass that first reads the result.
    """
    r = F.col("record")
    parts = F.transform(
        elements(element(r, "Abstract"), "AbstractText"),
        lambda t: F.struct(attribute(t["attrs"], "Label").alias("label"), clean_text(t["content"]).alias("text")),
    )
    abstract = F.array_join(
        F.transform(F.filter(parts, lambda p: p["text"] != ""), lambda p: F.when(p["label"] != "", F.concat(p["label"], F.lit(": "), p["text"])).otherwise(p["text"])), "\n\n"
    )
    entered = F.filter(elements(r, "PubMedPubDate"), lambda d: attribute(d["attrs"], "PubStatus") == "entrez")
    published = partial_date(element(element(element(r, "Journal"), "JournalIssue"), "PubDate"))
    heading = F.transform(contents(element(r, "MeshHeadingList"), "MeshHeading"), lambda h: F.get(elements(h, "DescriptorName"), 0))
    cleaned = F.transform(heading, lambda h: F.struct(clean_text(h["content"]).alias("name"), (attribute(h["attrs"], "MajorTopicYN") == "Y").alias("major")))
    named = F.filter(cleaned, lambda h: h["name"] != "")
    places = F.filter(elements(r, "ELocationID"), lambda e: attribute(e["attrs"], "EIdType") == "doi")
    texts = lambda tag, within: F.filter(F.transform(contents(within, tag), lambda e: clean_text(e)), lambda x: x != "")
    df = records.select(
        clean_text(element(r, "PMID")).alias("pmid"), clean_text(element(r, "ArticleTitle")).alias("title"), abstract.alias("abstract"),
        clean_text(element(element(r, "Journal"), "ISOAbbreviation")).alias("journal"), texts("PublicationType", element(r, "PublicationTypeList")).alias("pub_types"),
        named.alias("mesh"),
        _authors(r).alias("authors"), _first_full(F.transform(entered, lambda d: partial_date(d["content"]))).alias("edat"),
        bound(published, lambda p: F.when(p != "", p).otherwise(partial_date(element(r, "ArticleDate")))).alias("pubdate"),
        F.nullif(_first_full(F.transform(places, lambda e: clean_text(e["content"]))), F.lit("")).alias("doi"), texts("Language", r).alias("language"),
    )
    # Made once, before the test of what is whole reads them.
    df = settled(df, *df.columns)
    names = lambda of: F.transform(of, lambda h: h["name"])
    df = df.select(*[c for f in df.columns for c in ([names(F.col(f)).alias(f), names(F.filter(f, lambda h: h["major"])).alias("mesh_major")] if f == "mesh" else [F.col(f)])])
    whole = (F.col("pmid") != "") & (F.col("title") != "") & (F.col("journal") != "") & F.col("edat").rlike(FULL_DATE) & F.col("pubdate").rlike(FULL_DATE)
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("records"), F.count(F.when(whole, None).otherwise(1)).alias("skipped"))
    return df.where(whole).withColumns({c: F.col(c).try_cast("date") for c in ("edat", "pubdate")})


def skipped(records: DataFrame, parsed: DataFrame) -> int:
    return records.count() - parsed.count()
