"""Tables by hash buckets under one commit pointer.

A version is a small JSON file that names, for each table, the folder of each bucket.  A
commit writes the buckets that change to new folders and then publishes the next version by
a rename; readers take the newest version, so they see all tables as they were before or
after, and what an unfinished commit left is never read.  Bytes written follow the buckets
that a batch touches.  There is one writer at a time; a second one fails on the rename.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.state import latest
from foliant.tables import delete


@dataclass(frozen=True)
class Spec:
    """How a table is kept: rows are told apart by ``keys``, dealt by ``bucket``; the highest ``order`` wins, without it the newer row."""

    bucket: str
    keys: tuple[str, ...]
    order: str | None = None


@dataclass
class Version:
    number: int = 0
    tables: dict = field(default_factory=dict)  # name: {"schema": ..., "buckets": {bucket: folder}}
    epochs: dict = field(default_factory=dict)  # stream: last epoch


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, specs: dict[str, Spec], buckets: int = 64) -> None:
        self.spark, self.root, self.specs, self.buckets = spark, root.rstrip("/"), specs, buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        at, fs = self._path("versions"), self._fs()
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version:
        """The newest version, or a given one; an empty one before the first commit."""
        numbers = self._numbers()
        if not numbers:
            return Version()
        text = self.spark.read.text(f"{self.root}/versions/{number or numbers[-1]:012d}.json", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def _publish(self, version: Version) -> None:
        fs, to = self._fs(), self._path(f"versions/{version.number:012d}.json")
        draft = self._path(f"drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(draft, to):
            raise RuntimeError(f"version {version.number} is there already: another writer was first")

    # --- reading

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """All rows of a table as of a version."""
        return self._buckets(table, version or self.version(), None)

    def _buckets(self, table: str, version: Version, only: list[int] | None) -> DataFrame:
        known = version.tables.get(table)
        if known is None:
            raise FileNotFoundError(f"{self.root}: {table}")
        schema = T.StructType.fromJson(known["schema"])
        folders = [f"{self.root}/{f}" for b, f in sorted(known["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("int")

    def commit(self, upserts: dict[str, DataFrame] | None = None, removed: dict[str, DataFrame] | None = None, epoch: tuple[str, int] | None = None) -> int:
        """Rows that are new or replace others, by table, and rows to remove (by the columns that ``removed`` has).

        All of it becomes visible at once.  ``epoch`` (stream, number) makes a replay do
        nothing.  A row of ``upserts`` stays even where ``removed`` names its key.
        """
        now = self.version()
        if epoch and now.epochs.get(epoch[0], -1) >= epoch[1]:
            return now.number
        upserts, removed = upserts or {}, removed or {}
        after = Version(now.number + 1, dict(now.tables), dict(now.epochs) | ({epoch[0]: epoch[1]} if epoch else {}))
        for table in dict.fromkeys([*upserts, *removed]):
            changed = self._merged(table, now, upserts.get(table), removed.get(table), after.number)
            if changed:
                after.tables[table] = changed
        self._publish(after)
        return after.number

    def _merged(self, table: str, now: Version, new: DataFrame | None, gone: DataFrame | None, number: int) -> dict | None:
        spec, there = self.specs[table], now.tables.get(table)
        if there is None and new is None:
            return None
        schema = T.StructType.fromJson(there["schema"]) if there else new.schema
        hit = [d.select(self._bucket(spec.bucket).alias("b")) for d in (new, gone) if d is not None and spec.bucket in d.columns]
        if gone is not None and spec.bucket not in gone.columns:
            touched = [int(b) for b in there["buckets"]] if there else []
        else:
            touched = []
        for d in hit:
            touched += [r["b"] for r in d.distinct().collect()]
        touched = sorted(set(touched))
        if not touched:
            return None if there else {"schema": json.loads(schema.json()), "buckets": {}}
        old = self._buckets(table, now, touched) if there else self.spark.createDataFrame([], schema)
        if gone is not None:
            old = old.join(gone.distinct(), gone.columns, "left_anti").select(*schema.names)
        rows = old.withColumn("_new", F.lit(0))
        if new is not None:
            rows = rows.unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("_new", F.lit(1)))
        order = ([F.col(spec.order).desc_nulls_last()] if spec.order else []) + [F.col("_new").desc()]
        # Ties within a batch go to the rows' values, so that a result doesn't depend on partitions.
        order += [F.col(c).desc_nulls_last() for c in schema.names if not isinstance(schema[c].dataType, T.MapType)]
        folder = f"{table}/{number:012d}-{uuid.uuid4().hex}"
        kept = latest(rows, list(spec.keys), order).select(*schema.names).withColumn("_bucket", self._bucket(spec.bucket))
        kept.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        fs, at = self._fs(), self._path(folder)
        full = {int(n.removeprefix("_bucket=")) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("_bucket=")}
        buckets = {b: f for b, f in (there["buckets"] if there else {}).items() if int(b) not in touched}
        return {"schema": json.loads(schema.json()), "buckets": buckets | {str(b): f"{folder}/_bucket={b}" for b in full}}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes folders that none of the last ``keep`` versions reads, and older versions; returns the folders."""
        numbers = self._numbers()
        fs = self._fs()
        versions = [self.version(n) for n in numbers[-keep:]]
        read = {f.rsplit("/", 1)[0] for v in versions for t in v.tables.values() for f in t["buckets"].values()}
        dropped = []
        for table in self.specs:
            if fs.exists(self._path(table)):
                names = [f"{table}/{s.getPath().getName()}" for s in fs.listStatus(self._path(table))]
                dropped += [n for n in names if n not in read]
        for name in [*dropped, *[f"versions/{n:012d}.json" for n in numbers[:-keep]], "drafts"]:
            delete(self.spark, f"{self.root}/{name}")
        return dropped


#: Tables of users, all dealt by user, so that a user's rows of every table lie in one bucket each.
USER_TABLES = {
    "users": Spec("id", ("id",)), "templates": Spec("user_id", ("user_id", "slug")), "configs": Spec("user_id", ("user_id",)), "watches": Spec("user_id", ("user_id", "orcid")),
    "profiles": Spec("user_id", ("user_id", "polarity", "term")), "feedback": Spec("user_id", ("user_id", "item", "at")), "seen": Spec("user_id", ("user_id", "item")),
}
#: What users choose, and is replaced as a whole when they are saved; the rest is what was learned of them.
CHOSEN = ("templates", "configs", "watches")


def save_users(store: BucketStore, users: DataFrame, chosen: dict[str, DataFrame]) -> int:
    """Full replacement of users and their choices in one commit.

    Users that ``users`` lacks go, and their rows in every table with them; those that stay
    keep what was learned of them (profiles, feedback, what they have seen).
    """
    now = store.version()
    removed: dict[str, DataFrame] = {}
    if "users" in now.tables:
        old = store.read("users", now).select("id")
        gone = old.join(users.select("id"), "id", "left_anti")
        removed["users"] = gone
        by_user = gone.select(F.col("id").alias("user_id"))
        for t in now.tables:
            if t in CHOSEN:
                removed[t] = old.select(F.col("id").alias("user_id"))
            elif t != "users":
                removed[t] = by_user
    return store.commit({"users": users, **chosen}, removed)
