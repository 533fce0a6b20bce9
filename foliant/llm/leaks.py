"""Secret scans with corpus-wide ownership of what they find.

Patterns find candidates in a text; a candidate's value is known by its hash.  Over the
whole corpus each value's distinct owners and repositories are counted: a value in many
owners' hands is a copied example, one that few owners hold and that looks drawn at random
is live.  Verdicts go back to every place where the value stands, so a credential that is
named in one document is found in others where it stands bare.

Only hashes, places and ids of candidates are shuffled, never texts; counts are combined by
(value, owner, repository), then (value, owner), then value, before each shuffle, and places
meet verdicts in a join of tables read from files, which adaptive execution splits where a
value has very many places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, ship
from foliant.tables import Scratch

KINDS = ("assign", "access", "hex", "bare")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: What stands around a value without being part of it.
EDGES = "+/_.=-"
#: Words that mark a value as made up.
MADE_UP = ("example", "sample", "dummy", "changeme", "placeholder", "your", "test", "xxxx", "1234", "abcd")
PLACE = "array<struct<kind:int,start:int,stop:int,value:binary,random:boolean,evident:boolean>>"
SCANNED = f"doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, places {PLACE}"


def value_of(found: str) -> str:
    """What is told apart: without characters around it, and of ``name=value`` the value."""
    return found.strip(EDGES).rpartition("=")[2]


def looks_random(value: str) -> bool:
    """Letters and digits, at least eight characters that differ, no made-up word."""
    low = value.lower()
    return len(set(value)) >= 8 and bool(re.search("[A-Za-z]", value)) and bool(re.search("[0-9]", value)) and not any(w in low for w in MADE_UP)


def looks_evident(value: str) -> bool:
    """Random enough to be a credential wherever it stands: long, both cases, digits, many characters that differ."""
    return len(value) >= 20 and len(set(value)) >= 12 and bool(re.search("[a-z]", value)) and bool(re.search("[A-Z]", value)) and looks_random(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) in order."""
    out = []
    # The pattern has no fixed first letter; finding plain words is much faster.
    low = text.lower()
    if any(w in low for w in NAMES):
        out += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
    """Runs with letters and digits that touch no base span, without what stands around them."""
    if not re.search("[0-9]", text):
        return
    at, ends = 0, []
    for start, _, end, _ in base:
        ends.append((start, max(end, ends[-1][1] if ends else 0)))
    for m in RUN.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if at < len(ends) and ends[at][0] < m.end():
            continue
        value = value_of(m[0])
        if len(value) >= 12 and looks_random(value):
            end = m.start() + len(m[0].rstrip(EDGES))
            yield end - len(value), 3, end, value


def join_spans(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan(docs: DataFrame, owner: str, repository: tuple[str, ...]) -> DataFrame:
    """Counts and hash of the base spans of every row, and the places of all candidates."""
    key = F.to_json(F.struct(*[docs[c].cast("string").alias(f"c{i}") for i, c in enumerate(repository)]), {"ignoreNullFields": "false"})
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs[owner].cast("string").alias("owner"), key.alias("repository"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            counts, digests, places = ([], [], []), [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                both = []
                for a, k, z, secret in (*base, *bare_spans(text, base)):
                    v = value_of(secret)
                    both.append({"kind": k, "start": a, "stop": z, "value": hashlib.sha256(v.encode()).digest()[:16], "random": looks_random(v), "evident": looks_evident(v)})
                places.append(both)
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("random", pa.bool_()), ("evident", pa.bool_())]))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("owner"), b.column("repository"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(places, kind)],
                ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "places"],
            )

    return own.mapInArrow(run, SCANNED)


def ownership(places: DataFrame, copied: int) -> DataFrame:
    """value, n_owners, n_repositories, n_places, named, copied, live: a row for each value of the corpus.

    places: value, owner, repository, named (part of a base span), random.
    """
    one = places.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named"), F.max("random").alias("random"))
    two = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"), F.max("named").alias("named"), F.max("random").alias("random"))
    every = two.groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_places"), F.max("named").alias("named"), F.max("random").alias("random")
    )
    wide = F.col("n_owners") >= copied
    return every.withColumns({"copied": wide, "live": ~wide & F.col("random")}).drop("random")


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), copied: int = 5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of every row.

    ``spans`` has all base spans and, as ``bare``, the places of values that fewer than
    ``copied`` owners hold and that some document names in a base span, or that are evident
    by themselves.  ``n_live`` counts the listed spans with live values, ``n_copied`` base
    spans with copied ones.

    Null texts are empty; rows that repeat an id, or have none, are scanned each.  A null
    owner or repository is one of its own.  Long texts are scanned whole.  An empty table
    gives an empty result.  Columns other than doc_id, text, owner and repository are ignored.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "leaks")
    scanned = scratch.keep(scan(docs, owner, repository).withColumn("_row", F.monotonically_increasing_id()))
    places = scanned.where(F.size("places") > 0).select("_row", "owner", "repository", F.explode("places").alias("p"))
    flat = places.select("_row", "owner", "repository", "p.*").withColumn("named", F.col("kind") < KINDS.index("bare"))
    known = scratch.keep(ownership(flat, copied).select("value", F.col("named").alias("_known"), "copied", "live"))
    met = flat.drop("owner", "repository").join(known, "value")
    listed = met.where("named or (not copied and (_known or evident))")
    label = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", "kind", "stop", F.concat_ws(":", label, "start", "stop").alias("s"))
    own = listed.groupBy("_row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(span)), lambda x: x["s"]), ",").alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
    )
    out = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    result = scanned.where(F.size("places") > 0).select("_row", *out).join(own, "_row", "left")
    filled = result.select(*out, F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")])
    scratch.leave(scanned, known)
    none = scanned.where(F.size("places") == 0).select(*out, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return filled.unionByName(none)
