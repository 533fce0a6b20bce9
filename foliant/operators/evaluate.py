"""Agreement of a ranking with archived, tagged digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_archive(lines: DataFrame, host: str = r"ncbi\.nlm\.nih\.gov") -> DataFrame:
    """(doc, ord, item, title, section, tag) of archived markdown, from (doc, n, line).

    An entry is a link; its title is the last ### before it, its tag the first Tag line
    after it and before the next entry or heading.
    """
    w = W.partitionBy("doc").orderBy("n")
    df = lines.withColumns({
        "_sec": F.nullif(F.regexp_extract("line", r"^##\s+([^#].*?)\s*$", 1), F.lit("")), "_ttl": F.nullif(F.regexp_extract("line", r"^###\s+(.+?)\s*$", 1), F.lit("")),
        "_id": F.nullif(F.regexp_extract("line", host + r"/(\d+)", 1), F.lit("")), "_tag": F.when(F.col("line").rlike(r"\*\*Tag:\*\*\s*\["), F.trim(F.regexp_extract("line", r"\*\*Tag:\*\*\s*\[([^\]]*)\]", 1))),
    })
    plain = F.col("_sec").isNull() & F.col("_ttl").isNull()
    df = df.withColumns({"_id": F.when(plain, F.col("_id")), "_tag": F.when(plain & F.col("_id").isNull(), F.col("_tag"))})
    df = df.withColumn("_run", F.sum((F.col("_sec").isNotNull() | F.col("_ttl").isNotNull() | F.col("_tag").isNotNull()).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumns({"section": F.coalesce(F.last("_sec", True).over(w), F.lit("Unknown")), "_ttl_at": F.last(F.when(F.col("_ttl").isNotNull(), F.col("n")), True).over(w), "title": F.coalesce(F.last("_ttl", True).over(w), F.lit(""))})
    run = W.partitionBy("doc", F.coalesce("_run", F.lit(0)))
    df = df.withColumn("tag", F.coalesce(F.max("_tag").over(run), F.lit("")))
    last = df.where("_id is not null").withColumn("_r", F.row_number().over(W.partitionBy("doc", F.coalesce("_run", F.lit(0))).orderBy(F.col("n").desc()))).where("_r = 1")
    return last.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("n")) - 1).alias("ord"), F.col("_id").alias("item"), "title", "section", "tag")


def retention(entries: DataFrame, kept: DataFrame, key: str = "item") -> DataFrame:
    hit = entries.join(kept.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    return hit.agg(F.count("_k").alias("kept"), F.count(F.lit(1)).alias("entries")).withColumn("retention", F.try_divide(F.col("kept").cast("double"), F.col("entries")))


def section_agreement(entries: DataFrame, assigned: DataFrame, alias: DataFrame, key: str = "item") -> DataFrame:
    """Share of comparable entries (whose archived section has a name here) in the same section."""
    both = entries.join(F.broadcast(alias.withColumnRenamed("archived", "section")), "section").where("ours != '*'").join(assigned.select(key, F.col("section").alias("_s")), key)
    return both.agg(F.sum((F.col("ours") == F.col("_s")).cast("long")).alias("agreed"), F.count(F.lit(1)).alias("comparable")).withColumn("agreement", F.try_divide(F.col("agreed").cast("double"), F.col("comparable")))


def top_share(scored: DataFrame, flag: Column, most: int = 25, key: str = "item") -> DataFrame:
    """How many flagged rows are among the ``most`` best."""
    top = scored.orderBy(F.col("score").desc(), F.col(key)).limit(most)
    return top.agg(F.sum(flag.cast("long")).alias("inside")).crossJoin(scored.agg(F.sum(flag.cast("long")).alias("flagged")))


def auc(scored: DataFrame, positive: Column, by: list[str] | None = None, ranges: int = 200) -> DataFrame:
    """(wins + ties / 2) / (positives * negatives), from counts by score rather than pairs.

    Scores are counted first (combining before the shuffle).  What lies below a score is what
    lies in lower ranges of scores, of which there are few, and in its own: so no task orders
    all distinct scores.
    """
    by = by or []
    flagged = scored.select(*by, F.col("score").cast("double").alias("score"), positive.cast("long").alias("_p"), (~positive).cast("long").alias("_n"))
    bounds = flagged.agg(F.array_distinct(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000)).alias("_bounds"))
    counts = flagged.groupBy(*by, "score").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    at = F.size(F.filter("_bounds", lambda x: x < F.col("score")))
    counts = counts.crossJoin(F.broadcast(bounds)).withColumn("_range", F.coalesce(at, F.lit(0))).drop("_bounds")
    lower = W.partitionBy(*by, F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(lower), F.lit(0))).drop("_sum")
    own = W.partitionBy(*by, "_range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    within = counts.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    below = within.join(starts, [*by, "_range"]).withColumn("_below", F.col("_start") + F.col("_own"))
    sums = below.groupBy(*by).agg(F.sum(F.col("_p") * (2 * F.col("_below") + F.col("_n"))).alias("_w"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    return sums.select(*by, "positives", "negatives", F.try_divide(F.col("_w").cast("double"), 2.0 * F.col("positives") * F.col("negatives")).alias("auc"))


def mean_by_tag(scored: DataFrame, tag: str = "tag") -> DataFrame:
    return scored.groupBy(tag).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: list[str], key: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) of ranks within groups; ties rank by ``key``; null below three rows."""
    rank = lambda c: F.row_number().over(W.partitionBy(*by).orderBy(c, key))
    d = df.withColumns({"_d": (rank(x) - rank(y)).cast("long")})
    sums = d.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return sums.select(*by, "n", F.when(F.col("n") >= 3, 1 - 6 * F.col("_s") / (n * (n * n - 1))).alias("rho"))
