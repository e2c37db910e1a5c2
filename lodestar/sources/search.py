"""A search service as a Python data source: adaptive date windows, batched fetches that isolate a bad id, rate limits.

The service itself is a callable that the caller registers, so tests and
offline runs bring a fixture and a cluster brings a client.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST = 9_998
BATCH = 200


class Transient(Exception):
    """An answer worth another try (408, 429, 5xx)."""


def retry(call: Callable, tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Powers of two between tries."""
    for k in range(tries):
        try:
            return call()
        except Transient:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)


def plan_windows(count: Callable[[date, date], int], start: date, end: date, most: int = MOST) -> list[tuple[date, date, int]]:
    """Halve a window until its hits can be paged; a single day above that is kept and shows its count."""
    n = count(start, end)
    if n == 0:
        return []
    if n <= most or start == end:
        return [(start, end, n)]
    middle = start + timedelta(days=(end - start).days // 2)
    return plan_windows(count, start, middle, most) + plan_windows(count, middle + timedelta(days=1), end, most)


def fetch(ids: list[str], get: Callable[[list[str]], list[dict]]) -> Iterator[tuple[str, dict | None, str | None]]:
    """Records by id; a failing batch is halved until the bad id stands alone, which becomes a row with its error."""
    if not ids:
        return
    try:
        records = retry(lambda: get(ids))
    except Exception as e:
        if len(ids) == 1:
            yield ids[0], None, f"{type(e).__name__}: {e}"
        else:
            yield from fetch(ids[: len(ids) // 2], get)
            yield from fetch(ids[len(ids) // 2 :], get)
        return
    found = {r["id"]: r for r in records}
    for i in ids:
        yield i, found.get(i), None if i in found else "not in the answer"


@dataclass
class Window(InputPartition):
    start: date
    end: date
    hits: int


def source(name: str, search: Callable[[date, date], list[str]], get: Callable[[list[str]], list[dict]], most: int = MOST) -> type[DataSource]:
    """A DataSource class to register with spark.dataSource; options start and end, one partition per window."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.start, self.end = (date.fromisoformat(options[k]) for k in ("start", "end"))

        def partitions(self):
            return [Window(*w) for w in plan_windows(lambda a, b: len(search(a, b)), self.start, self.end, most)]

        def read(self, partition):
            ids = search(partition.start, partition.end)
            for k in range(0, len(ids), BATCH):
                for i, record, error in fetch(ids[k : k + BATCH], get):
                    yield i, (record or {}).get("title"), (record or {}).get("date"), error

    class Search(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "id string, title string, date string, error string"

        def reader(self, schema):
            return Reader(self.options)

    return Search
