"""Answers of web services as a data source: pages fetched in parallel, with retries.

``spark.dataSource.register(Pages)`` makes the format ``pages`` known; option
``urls`` lists addresses, one a line, and ``batch`` says how many one task
fetches.  The result is text for the functions in ``services``.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES = 3
BACKOFF = 0.5
PAUSE = 0.08
#: Answers after which a request is tried again.
RETRIED = (429, 500, 502, 503, 504)


def fetch(url: str, tries: int = TRIES, backoff: float = BACKOFF, timeout: float = 30) -> tuple[str | None, str | None]:
    """SRC-21: ``(text, fault)`` of one address; waits twice as long before each further try."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return answer.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            fault = f"HTTP {e.code}"
            if e.code not in RETRIED:
                return None, fault
        except (OSError, ValueError) as e:
            fault = type(e).__name__
        if n + 1 < tries:
            time.sleep(backoff * 2**n)
    return None, fault


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(None)
        self.urls = urls


class PagesReader(DataSourceReader):
    def __init__(self, urls: list[str], batch: int):
        self.urls, self.batch = urls, batch

    def partitions(self) -> list[InputPartition]:
        return [Urls(self.urls[i : i + self.batch]) for i in range(0, len(self.urls), self.batch)] or [Urls([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            if i:
                time.sleep(PAUSE)
            yield (url, *fetch(url))


class Pages(DataSource):
    """A page that can't be had gives a row with its fault, never an error that fails the job."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, value string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader([u for u in self.options.get("urls", "").split("\n") if u], int(self.options.get("batch", "50")))
