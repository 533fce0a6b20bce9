"""Keyed state: upserts, rolling windows, ledgers, feedback, users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``: a ranked window, of which each task passes on one row a key (group limit)."""
    rest = [c for c in df.columns if c not in keys]
    ranked = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(ranked)).where("_r = 1").select(*keys, *rest)


def upsert(store: DataFrame, batch: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``batch`` replace the store's; within the batch the last position wins."""
    both = store.withColumn("_new", F.lit(0)).withColumn(position, F.lit(0).cast("long")).unionByName(batch.withColumn("_new", F.lit(1)).withColumn(position, F.col(position).cast("long")))
    return latest(both, [key], [F.col("_new").desc(), F.col(position).desc()]).drop("_new", position)


def added(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys that the batch brings and the store lacks."""
    return batch.select(key).distinct().join(store.select(key), key, "left_anti")


def since(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(column) >= F.date_sub(as_of, days))


def prune(df: DataFrame, column: str, as_of: Column, days: int = 120) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) >= F.date_sub(as_of, days)))


def unseen(pool: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return pool.join(seen.select(*keys), keys, "left_anti")


def mark_seen(ledger: DataFrame, shown: DataFrame, keep: int = 5000) -> DataFrame:
    """(user_id, item, seen_at): first sightings, the newest ``keep`` of each user."""
    first = ledger.unionByName(shown).groupBy("user_id", "item").agg(F.min("seen_at").alias("seen_at"))
    w = W.partitionBy("user_id").orderBy(F.col("seen_at").desc(), F.col("item").desc())
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def record_feedback(events: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Last tag of each (user_id, item); with ``tokens``, only of events whose token is the user's."""
    if tokens is not None:
        events = events.join(tokens.select("user_id", "token"), ["user_id", "token"], "left_semi")
    return latest(events.where(F.col("tag").isin("star", "tilde", "skip")), ["user_id", "item"], [F.col("at").desc(), F.col("tag")])


def add_feedback(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with the events appended, none replaced."""
    return log.unionByName(events.select(*log.columns))


def load_feedback(log: DataFrame) -> DataFrame:
    """The log in order of time; ties by user, item and tag."""
    return log.orderBy("at", "user_id", "item", "tag")


def save_profile(stored: DataFrame, profile: DataFrame) -> DataFrame:
    """(user_id, polarity, term, weight): the given users' profiles replace theirs, others' stay."""
    return stored.join(profile.select("user_id").distinct(), "user_id", "left_anti").unionByName(profile.select(*stored.columns))


def load_profile(stored: DataFrame, users: DataFrame) -> DataFrame:
    return stored.join(users.select("user_id").distinct(), "user_id", "left_semi")


def page(df: DataFrame, key: str, after: Column | None, size: int = 1000) -> DataFrame:
    """The next ``size`` rows by ``key`` beyond ``after`` (null: from the start); a filter on the key, not an offset."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def confirm(users: DataFrame, clicks: DataFrame) -> DataFrame:
    """Sets verified_at once for users whose token was clicked; later clicks change nothing."""
    first = clicks.groupBy("user_id", "token").agg(F.min("at").alias("_at"))
    hit = users.join(first, (users["id"] == first["user_id"]) & (users["unsub_token"] == first["token"]), "left")
    return hit.select(*[users[c] for c in users.columns if c != "verified_at"], F.coalesce(users["verified_at"], "_at").alias("verified_at"))


def unsubscribe(users: DataFrame, clicks: DataFrame) -> DataFrame:
    """Users without those whose own token was clicked; a wrong token changes nothing."""
    hit = (F.col("u.id") == F.col("c.user_id")) & (F.col("u.unsub_token") == F.col("c.token"))
    return users.alias("u").join(clicks.select("user_id", "token").alias("c"), hit, "left_anti")


def load_users(
    users: DataFrame, templates: DataFrame, configs: DataFrame, watches: DataFrame, watchers: str = "user_id", told: Callable[[Column], Column] = lambda authors: authors
) -> DataFrame:
    """Users with their ordered templates, preferences (null without a row) and followed authors.

    ``watchers`` names the column of ``users`` and ``watches`` that says who follows: the user
    or, where many users follow the same authors, their group, whose list is then made once
    and not once a user.  Users of a group then lie together, so that a file of the result
    holds few lists, each of them once, whatever the number of users; ``told`` is what a list
    is shown as, made once a list too.
    """
    ordered = templates.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "slug"))), lambda x: x["slug"]).alias("templates"))
    followed = watches.groupBy(watchers).agg(told(F.array_sort(F.collect_list(F.struct("orcid", "label")))).alias("authors"))
    none = lambda k: F.array().cast(k)
    joined = users.withColumnRenamed("id", "user_id").join(ordered, "user_id", "left").join(configs, "user_id", "left")
    if watchers != "user_id":
        spark = users.sparkSession
        joined = joined.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), watchers, "user_id")
    joined = joined.join(followed, watchers, "left")
    return joined.withColumns({"templates": F.coalesce("templates", none("array<string>")), "authors": F.coalesce("authors", told(none("array<struct<orcid:string,label:string>>")))})


def save_users(old: DataFrame, new: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Full replacement: users that ``new`` lacks go, and their rows in every child table with them."""
    return new, {k: v.join(new.select(F.col("id").alias("user_id")), "user_id", "left_semi") for k, v in children.items()}


def subscribe(users: DataFrame, forms: DataFrame) -> DataFrame:
    """Upsert by lower-cased address: known users keep id, verification and token."""
    key = lambda df: df.withColumn("_k", F.lower("email"))
    old, new = key(users), latest(key(forms), ["_k"], [F.col("at").desc()])
    known = old.select("_k", F.col("id").alias("_id"), F.col("verified_at").alias("_v"), F.col("unsub_token").alias("_t"))
    fresh = new.join(known, "_k", "left").select(F.coalesce("_id", "id").alias("id"), "email", F.col("_v").alias("verified_at"), F.coalesce("_t", "unsub_token").alias("unsub_token"), "_k")
    kept = old.join(fresh.select("_k"), "_k", "left_anti").select("id", "email", "verified_at", "unsub_token")
    return kept.unionByName(fresh.drop("_k"))


def pull_plan(users: DataFrame, journals: DataFrame, default: str) -> DataFrame:
    """Distinct journals of all templates in use and the default one; unknown templates have none."""
    used = users.select(F.explode("templates").alias("slug")).union(users.sparkSession.createDataFrame([(default,)], "slug string")).distinct()
    return used.join(journals, "slug").select("journal").distinct()


def supplement(sweep: DataFrame, hits: DataFrame) -> DataFrame:
    """Items that followed authors wrote and the sweep lacks; the last author of an item counts."""
    one = latest(hits, ["item"], [F.col("position").desc()])
    return one.join(sweep.select("item"), "item", "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df
