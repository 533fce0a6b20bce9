"""Balanced label propagation: linked documents gather in few shards of equal row counts.

Documents with equal texts are linked.  Every document starts in the shard that its
rank in hash order gives, so that counts differ by one at most.  In each round

1. every group of linked documents counts its members by shard, and each member wants
   to be where most of its neighbours are;
2. a 16 x 16 table of wishes is turned into flows: two shards exchange as many movers as
   both have, and a mover without a counterpart changes places with a document that has
   no links.  Each flow has an equal one back, so the quotas hold exactly at all times;
3. the documents of a flow are the first by rank within (from, to).

Groups larger than a shard are split by a hash of the id first, since no shard could take
them whole.  Ranks are computed in two levels (hash buckets, then rows in a
bucket), so that no lane is sorted by a single task.

Only DataFrame functions are used; what reaches the driver has shards**2 rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.tables import cut

SETTLED, NEUTRAL = -2, -1
#: Buckets whose starts one task sums up.
RUN = 1000


def _ranked(df: DataFrame, lane: list[str], order: list[Column], buckets: int, name: str) -> DataFrame:
    """Adds ``name``: the row's rank from 0 within its lane, in order of (hash bucket, order)."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    # Starts of buckets are summed in two levels as well: runs of buckets, then buckets in a run.
    run = F.floor(F.col("_b") / RUN).cast("int")
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(*lane, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", run)
    runs = sizes.groupBy(*lane, "_run").agg(F.sum("_n").alias("_m")).withColumn("_first", F.coalesce(F.sum("_m").over(before(*lane).orderBy("_run")), F.lit(0)))
    own = F.coalesce(F.sum("_n").over(before(*lane, "_run").orderBy("_b")), F.lit(0))
    starts = sizes.withColumn("_own", own).join(runs.drop("_m"), [*lane, "_run"]).select(*lane, "_b", (F.col("_first") + F.col("_own")).alias("_start"))
    within = W.partitionBy(*lane, "_b").orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(within) - 1)
        .join(starts, [*lane, "_b"])
        .withColumn(name, F.col("_start") + F.col("_r"))
        .drop("_b", "_r", "_start")
    )


def flows(wishes: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (shard, want, low, high, to): documents ranked low..high-1 in a lane go to ``to``.

    ``wishes`` counts documents by (shard, wanted shard or NEUTRAL).  What leaves a shard
    equals what comes into it.
    """
    want = {k: v for k, v in wishes.items() if k[1] >= 0}
    admitted = {(i, j): min(n, want.get((j, i), 0)) for (i, j), n in want.items()}
    free = {s: wishes.get((s, NEUTRAL), 0) for s in range(shards)}
    used = dict.fromkeys(range(shards), 0)
    rows = []
    for i, j in sorted(want, key=lambda k: (-want[k], k)):
        swap = min(want[i, j] - admitted[i, j], free[j] - used[j])
        if swap:
            rows.append((j, NEUTRAL, used[j], used[j] + swap, i))
            used[j] += swap
        if admitted[i, j] + swap:
            rows.append((i, j, 0, admitted[i, j] + swap, j))
    return rows


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 4, bucket_rows: int = 3000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked for every row of ``docs``.

    ``law`` is ``rows``: shard counts are at most one apart.  Null text counts as the
    empty text.  Repeated rows are equal texts like any others; ties among rows with the
    same id are between rows that look the same; rows with a null id come first of their
    bucket.  Very long texts only have a large ``size``.  An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    base = cut(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("_key"),
    ))
    n = base.count()
    buckets = max(4, -(-n // bucket_rows))
    quota = max(1, n // shards)
    order = [F.col("doc_id"), F.col("_key")]

    groups = cut(
        base.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .withColumn("_parts", F.ceil(F.col("_n") / quota).cast("int"))
    )
    # The sizes come from files, not from an aggregation of the same key: a hot text's
    # rows then form a skewed join, which adaptive execution splits.
    state = (
        _ranked(base.withColumn("_all", F.lit(0)), ["_all"], order, buckets, "_rank").drop("_all")
        .withColumn("shard", (F.col("_rank") % shards).cast("int")).drop("_rank")
    )
    state = cut(state).join(groups, "_key", "left").withColumn(
        "_unit", F.when(F.col("_n") > 1, F.xxhash64("_key", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("_parts"))))
    ).select("doc_id", "size", "text_crc32", "_unit", "shard")
    state = cut(state)

    for _ in range(rounds):
        votes = state.where("_unit is not null").groupBy("_unit", "shard").agg(F.count(F.lit(1)).alias("_votes"))
        best = cut(
            votes.groupBy("_unit")
            .agg(F.max(F.struct("_votes", F.xxhash64("_unit", "shard").alias("_tie"), F.col("shard"))).alias("_best"))
            .select("_unit", F.col("_best.shard").alias("_to"))
        )
        wishing = cut(state.join(best, "_unit", "left").withColumn(
            "_want",
            F.when(F.col("_unit").isNull(), NEUTRAL).when(F.col("_to") == F.col("shard"), SETTLED).otherwise(F.col("_to")),
        ).drop("_to"))
        wishes = {(r["shard"], r["_want"]): r["n"] for r in wishing.groupBy("shard", "_want").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = flows(wishes, shards)
        if not plan:
            break
        moves = F.broadcast(spark.createDataFrame(plan, "shard int, _want int, _low long, _high long, _dest int"))
        ranked = _ranked(wishing, ["shard", "_want"], [F.col("doc_id"), F.col("text_crc32")], buckets, "_rank")
        m = moves.select(F.col("shard").alias("_s"), F.col("_want").alias("_w"), "_low", "_high", "_dest")
        state = cut(
            ranked.join(m, (F.col("shard") == F.col("_s")) & (F.col("_want") == F.col("_w")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")), "left")
            .select("doc_id", "size", "text_crc32", "_unit", F.coalesce("_dest", "shard").alias("shard"))
        )
    return _ranked(state, ["shard"], [F.col("doc_id"), F.col("text_crc32")], buckets, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_unit").isNotNull().alias("linked"),
    )


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: edges (pairs of equal texts, told by checksum and size), and how many of them two shards cut."""
    pairs = lambda n: n * (n - 1) / 2
    here = sharded.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("_n"))
    texts = here.groupBy("text_crc32", "size").agg(F.sum("_n").alias("_all"), F.sum(pairs(F.col("_n"))).alias("_within"))
    sums = texts.agg(F.sum(pairs(F.col("_all"))).alias("edges"), F.sum(pairs(F.col("_all")) - F.col("_within")).alias("cut"))
    return sums.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("edges", "cut")])
