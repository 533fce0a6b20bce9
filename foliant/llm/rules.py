"""Quality rules: counted statistics, then robust multivariate outliers by language and source.

Statistics are counted per document with array functions.  Their transformed vectors go
through a deterministic minimum-covariance-determinant estimate for each (language,
source): from several robust starts, concentration steps keep the ``share`` of rows with
the smallest Mahalanobis distances and re-estimate centre and covariance from them; the
start with the smallest determinant wins.  A document whose distance under the winning,
consistency-scaled estimate exceeds the cut-off is rejected.

Every step is one pass: rows add their moments to the bin of their log distance (combined
before the shuffle), and the bins up to the share's are summed.  So no group is ever
gathered, and what a step makes has a few hundred rows a group.  Groups with too few rows
share the estimate of their language, or of the whole table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.tables import Scratch

BLANKS = r"[\x20\x09-\x0D]+"
#: Smallest standard deviation that is believed of each transformed statistic.  The last two
#: are shares: alone, a share of repeated words above 0.40 or of repeated lines above 0.64 rejects.
FLOORS = {"x_len": 0.2, "x_word": 0.03, "x_symbol": 0.55, "x_repeat": 0.055, "x_line": 0.09}
X = list(FLOORS)
LOWER = [(i, j) for i in range(len(X)) for j in range(i + 1)]
#: Groups in a table that may be broadcast; beyond it parameters are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Bins of a statistic's histogram in its floor, and of squared distances in an octave.
FINE, OCTAVE = 8, 16


def chi2_share(x: float, dof: int) -> float:
    """Chi-square distribution function for odd degrees of freedom."""
    total, term = 0.0, math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, dof, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi2_quantile(share: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_share(mid, dof) < share else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Scale that makes the covariance of the central ``share`` of a normal vector that of the whole."""
    return share / chi2_share(chi2_quantile(share, len(X)), len(X) + 2)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts that rules look at; null text has no words."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    df = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"),
        F.array_remove(F.split(text, BLANKS), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.size("_w") - 2)).alias("_h"),
    )
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    same = lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"])
    at = F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])
    df = df.withColumn("_p", F.sort_array(at)).drop("_s")
    # Windows are three words long, so each adds the words up to the next repeated one.
    span = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(span, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return df.withColumns({
        "x_len": F.log1p(F.col("n_words").cast("double")),
        "x_word": F.log(chars / words),
        "x_symbol": F.log1p(1000.0 * F.col("n_symbols") / chars),
        "x_repeat": F.col("n_repeat_words") / words,
        "x_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    })


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _up_to(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """The rows (``by``, _bin, _n, ...) of the smallest bins that together hold ``share`` of each group."""
    before = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    df = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(W.partitionBy(*by))})
    return df.where(F.col("_before") < share * F.col("_all")).drop("_before", "_all")


def _starts(df: DataFrame) -> DataFrame:
    """(_g, start, m_*, p_*): centres and precisions of two starts from medians and absolute deviations.

    One histogram of all statistics gives both: deviations are counted from its bins.
    """
    cell = lambda i, a: F.struct(F.lit(i).alias("_i"), F.floor(F.col(a) * (FINE / FLOORS[a])).cast("int").alias("_bin"))
    counts = df.select("_g", F.explode(F.array(*[cell(i, a) for i, a in enumerate(X)])).alias("_c")).groupBy("_g", "_c._i", "_c._bin").agg(F.count(F.lit(1)).alias("_n"))
    key = ["_g", "_i"]
    centred = counts.withColumn("_all", F.sum("_n").over(W.partitionBy(*key))).withColumn(
        "_before", F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_med", F.max(F.when(F.col("_before") < 0.5 * F.col("_all"), F.col("_bin"))).over(W.partitionBy(*key)))
    off = centred.groupBy(*key, F.abs(F.col("_bin") - F.col("_med")).alias("_bin")).agg(F.sum("_n").alias("_n"), F.first("_med").alias("_med"))
    found = _up_to(off, key, 0.5).groupBy(*key).agg(F.max("_bin").alias("_mad"), F.first("_med").alias("_med"))
    pick = lambda i, c: F.max(F.when(F.col("_i") == i, (F.col(c) + 0.5) * (FLOORS[X[i]] / FINE)))
    one = found.groupBy("_g").agg(*[pick(i, "_med").alias(f"m_{i}") for i in range(len(X))], *[pick(i, "_mad").alias(f"_d_{i}") for i in range(len(X))])
    narrow = {X.index("x_word"), X.index("x_symbol")}

    def precision(i: int, j: int) -> Column:
        if i != j:
            return F.lit(0.0)
        wide = 1 / F.pow(F.greatest(1.4826 * F.col(f"_d_{i}"), F.lit(FLOORS[X[i]])), 2)
        return wide if i in narrow else F.when(F.col("start") == 0, wide).otherwise(0.0)

    both = one.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("_g", "start", *[f"m_{i}" for i in range(len(X))], *[precision(i, j).alias(f"p_{i}_{j}") for i, j in LOWER])


def _distance() -> Column:
    """Squared Mahalanobis distance under m_*, p_* (those off the diagonal are doubled)."""
    d = [f"({a} - m_{i})" for i, a in enumerate(X)]
    rows = [f"{d[i]} * ({' + '.join(f'p_{i}_{j} * {d[j]}' for j in range(i + 1))})" for i in range(len(X))]
    return F.expr(f"greatest({' + '.join(rows)}, 0.0D)")


def _estimate(kept: DataFrame, scale: float) -> DataFrame:
    """(_g, start, det, m_*, p_*) from sums _n, s_*, s_*_*: centre, and the inverse of the floored, scaled covariance.

    The algebra is stated as one query of nested selects: means, covariances, the columns of
    the Cholesky factor, the rows of its inverse, and the inverse's products.
    """
    n = len(X)
    floor = [FLOORS[a] for a in X]
    cov = {(i, j): f"(s_{i}_{j} / _n - m_{i} * m_{j}) * {scale!r}D" for i, j in LOWER}
    layers = [
        {f"m_{i}": f"s_{i} / _n" for i in range(n)},
        {f"c_{i}_{j}": f"greatest({cov[i, j]}, 0.0D) + {floor[i] ** 2!r}D" if i == j else cov[i, j] for i, j in LOWER},
    ]
    for j in range(n):
        rest = {i: " - ".join([f"c_{i}_{j}", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]]) for i in range(j, n)}
        layers.append({f"l_{j}_{j}": f"sqrt(greatest({rest[j]}, {(0.5 * floor[j]) ** 2!r}D))"})
        layers.append({f"l_{i}_{j}": f"({rest[i]}) / l_{j}_{j}" for i in range(j + 1, n)})
    layers.append({f"v_{i}_{i}": f"1 / l_{i}_{i}" for i in range(n)})
    layers += [{f"v_{i}_{j}": f"-({' + '.join(f'l_{i}_{k} * v_{k}_{j}' for k in range(j, i))}) / l_{i}_{i}" for j in range(i)} for i in range(1, n)]
    layers.append({f"p_{i}_{j}": f"({' + '.join(f'v_{k}_{i} * v_{k}_{j}' for k in range(i, n))}) * {1 if i == j else 2}" for i, j in LOWER})
    query = "{kept}"
    for layer in layers:
        if layer:
            query = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in layer.items())} FROM {query})"
    out = [f"m_{i}" for i in range(n)] + [f"p_{i}_{j}" for i, j in LOWER]
    return kept.sparkSession.sql(f"SELECT _g, start, {' + '.join(f'ln(l_{i}_{i})' for i in range(n))} AS det, {', '.join(out)} FROM {query}", kept=kept)


def robust_estimates(df: DataFrame, scratch: Scratch, groups: int, share: float = 0.75, steps: int = 3) -> DataFrame:
    """df: _g and X, with so many ``groups``.  Returns (_g, m_*, p_*) of the best start's estimate."""
    params = scratch.keep(_starts(df))
    sums = {f"s_{i}": a for i, a in enumerate(X)} | {f"s_{i}_{j}": f"{X[i]} * {X[j]}" for i, j in LOWER}
    moments = [F.expr("count(1) AS _n"), *[F.expr(f"sum({v}) AS {k}") for k, v in sums.items()]]
    again = [F.expr(f"sum({c}) AS {c}") for c in ("_n", *sums)]
    for _ in range(steps):
        bins = attach(df, params, groups).withColumn("_bin", F.floor(F.log2(_distance() + 1e-9) * OCTAVE).cast("int")).groupBy("_g", "start", "_bin").agg(*moments)
        kept = _up_to(bins, ["_g", "start"], share).groupBy("_g", "start").agg(*again)
        after = scratch.keep(_estimate(kept, consistency(share)))
        scratch.drop(params)
        params = after
    best = params.groupBy("_g").agg(F.min_by(F.struct(*[c for c in params.columns if c[:2] in ("m_", "p_")]), F.struct("det", "start")).alias("_b"))
    done = scratch.keep(best.select("_g", "_b.*"))
    scratch.drop(params)
    return done


def attach(df: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """Joins parameters of groups; the broadcast is taken only below a counted bound."""
    return df.join(F.broadcast(params) if groups <= BROADCAST_GROUPS else params, "_g")


def quality_rules(docs: DataFrame, confidence: float = 1 - 1e-9, min_group: int = 200, share: float = 0.75) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``distance`` and ``kept``.

    The squared distance is cut off at the ``confidence`` quantile of its chi-square law.
    Documents that fail the base rules take no part in the estimates and have a null
    distance.  A null language or source is a value of its own; null and empty texts have
    no words and fail; rows with a null or repeated id each count; a very long text is counted
    whole; rows with equal statistics share a verdict; an empty table gives an empty result.  Columns other than doc_id, text, lang and source are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    as_key = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = scratch.keep(_vector(document_statistics(docs)).select(*out, as_key("lang").alias("_lang"), as_key("lang", "source").alias("_k"), base_failed().alias("base_failed"), *X))
    sound = stats.where("not base_failed")
    small = F.col("_n") < min_group
    by_lang = F.sum(F.when(small, F.col("_n"))).over(W.partitionBy("_lang"))
    by_source = sound.groupBy("_lang", "_k").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ln", by_lang)
    named = scratch.keep(by_source.select("_k", F.when(~small, F.col("_k")).when(F.col("_ln") >= min_group, F.col("_lang")).otherwise("*").alias("_g")))
    groups = named.count()
    keyed = sound.join(F.broadcast(named) if groups <= BROADCAST_GROUPS else named, "_k")
    best = robust_estimates(keyed.select("_g", *X), scratch, groups, share)
    judged = attach(keyed, best, groups).withColumn("distance", _distance())
    scratch.leave(stats, named, best)
    return judged.select(*out, "base_failed", "distance", (F.col("distance") <= chi2_quantile(confidence, len(X))).alias("kept")).unionByName(
        stats.where("base_failed").select(*out, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    )
