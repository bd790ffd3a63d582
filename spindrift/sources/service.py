"""Sources that fetch chunks or pages from a service, with retries."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retries(call: Callable, tries: int = 12, wait: float = 10.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep):
    """call(attempt) until it gives a result; waits `wait` seconds more after every failure, `most` at most."""
    for attempt in range(tries):
        try:
            return call(attempt)
        except OSError:
            if attempt == tries - 1:
                raise
            sleep(min(most, wait * (attempt + 1)))
    raise ValueError("tries must be positive")


class Part(InputPartition):
    """A box of degrees, or a page: numbers that the fetch function is called with."""

    def __init__(self, *numbers: float):
        super().__init__(numbers)


class _Reader(DataSourceReader):
    def __init__(self, options, parts: list[Part]):
        self.name, self.parts = options["fetch"], parts
        self.endpoints = [e for e in options.get("endpoints", "").split(",") if e] or [""]
        self.tries, self.wait = int(options.get("tries", 12)), float(options.get("wait", 10))

    def partitions(self) -> list[Part]:
        return self.parts

    def read(self, partition: Part) -> Iterator[tuple]:
        module, name = self.name.split(":")
        fetch = getattr(importlib.import_module(module), name)
        yield from with_retries(lambda k: fetch(self.endpoints[k % len(self.endpoints)], *partition.value), self.tries, self.wait)


class ChunkedSource(DataSource):
    """Boxes of `step` degrees over x0, y0, x1, y1, one task each; option `fetch` names a function `module:name`.

    fetch(endpoint, x0, y0, x1, y1) gives rows of the schema that the reader was told. Failed calls (OSError) are tried again,
    each time at the next of the `endpoints`.
    """

    @classmethod
    def name(cls) -> str:
        return "chunked"

    def schema(self) -> str:
        raise ValueError("a chunked source needs a schema")

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        x0, y0, x1, y1, step = (float(o[k]) for k in ("x0", "y0", "x1", "y1", "step"))
        return _Reader(o, [Part(x, y, min(x + step, x1), min(y + step, y1)) for y in _steps(y0, y1, step) for x in _steps(x0, x1, step)])


class PagedSource(DataSource):
    """Pages of `page` rows of a service with `count` rows, one task each; fetch(endpoint, offset, rows) gives rows."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema")

    def reader(self, schema) -> DataSourceReader:
        n, page = int(self.options["count"]), int(self.options["page"])
        return _Reader(self.options, [Part(at, min(page, n - at)) for at in range(0, n, page)])


def _steps(low: float, high: float, step: float) -> list[float]:
    out, k = [], 0
    while low + k * step < high:
        out.append(low + k * step)
        k += 1
    return out


def sample_grid(endpoint: str, x0: float, y0: float, x1: float, y1: float) -> Iterator[tuple]:
    """A source for tests, without a network: the whole degrees of a box."""
    for x in range(int(-(-x0 // 1)), int(-(-x1 // 1))):
        for y in range(int(-(-y0 // 1)), int(-(-y1 // 1))):
            yield x, y


def sample_page(endpoint: str, offset: int, n: int) -> Iterator[tuple]:
    """A source for tests, without a network: numbers and their squares."""
    for k in range(offset, offset + n):
        yield k, k * k
