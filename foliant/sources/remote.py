"""Batched fetches from a record service: planning on the driver, fetching in the tasks.

``transport`` maps a request to (status, body); production code passes an HTTP client, tests
and air-gapped runs a function over files.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.forms import ORCID

Transport = Callable[[str, dict], tuple[int, str]]


def request(transport: Transport, path: str, params: dict, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Retries network errors, 429 and server errors, waiting twice as long each time; other answers are final."""
    failure: Exception | None = None
    for k in range(attempts):
        if k:
            sleep(wait * 2 ** (k - 1))
        try:
            status, body = transport(path, params)
        except OSError as e:
            failure = e
            continue
        if status < 400:
            return body
        failure = RuntimeError(f"{path}: status {status}")
        if status != 429 and status < 500:
            break
    raise failure or RuntimeError("no attempt was made")


def union_query(journals: list[str]) -> str:
    if not journals:
        raise ValueError("no journals to search")
    return " OR ".join(f'"{j}"[ta]' for j in journals)


def search(transport: Transport, term: str, days: int, most: int = 500, **kw) -> list[str]:
    body = request(transport, "esearch", {"term": term, "datetype": "edat", "reldate": days, "retmax": most, "retmode": "json"}, **kw)
    try:
        return list(json.loads(body)["esearchresult"]["idlist"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the search answered something else than ids") from e


def search_authors(transport: Transport, orcids: list[str], days: int = 7, **kw) -> tuple[dict[str, list[str]], dict[str, str]]:
    """(ids by ORCID, errors by ORCID): one author's failure is theirs alone."""
    found, failed = {}, {}
    for o in dict.fromkeys(orcids):
        try:
            if not re.match(ORCID, o):
                raise ValueError("not an ORCID")
            found[o] = search(transport, f"{o}[auid]", days, 200, **kw)
        except (ValueError, RuntimeError, OSError) as e:
            failed[o] = str(e)
    return found, failed


def fetch(ids: DataFrame, transport: Transport, column: str = "pmid", batch: int = 200, pace: float = 0.35) -> DataFrame:
    """(xml) of the ids' records, ``batch`` ids a request, paced within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def get(part: list[str]) -> pa.RecordBatch:
            time.sleep(pace)
            return pa.record_batch([pa.array([request(transport, "efetch", {"id": ",".join(part), "retmode": "xml"})])], ["xml"])

        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= batch:
                yield get(held[:batch])
                held = held[batch:]
        if held:
            yield get(held)

    return ids.select(F.col(column).cast("string").alias("id")).mapInArrow(run, "xml string")


def harvest(spark: SparkSession, transport: Transport, journals: list[str], days: int, most: int = 500, parts: int = 1, **kw) -> DataFrame:
    """(xml) of all records that a search of the journals finds: one search, then fetches of its ids in ``parts`` tasks.

    The service's pace holds for all tasks together, so each waits ``parts`` times as long.
    """
    pace = kw.pop("pace", 0.35) * max(1, parts)
    ids = search(transport, union_query(journals), days, most, **kw)
    if len(ids) >= most:
        raise ValueError(f"the search has {most} records or more; ask for more, or for fewer days")
    return fetch(spark.createDataFrame([(i,) for i in ids], "pmid string").repartition(max(1, parts)), transport, pace=pace)


class Store:
    """Tables by name in one folder or catalog: what operators read and replace without knowing where it lies."""

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}") if "/" in self.at else self.spark.table(f"{self.at}.{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, "append")

    def replace(self, name: str, rows: DataFrame) -> None:
        """``rows`` must not be read from the table itself."""
        self._write(name, rows, "overwrite")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        w = rows.write.mode(mode)
        w.parquet(f"{self.at}/{name}") if "/" in self.at else w.saveAsTable(f"{self.at}.{name}")
