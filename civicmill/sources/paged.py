"""Paged services as a Spark data source: windows of dates small enough for one query each, pages followed by their cursor.

A service answers three questions about records that bear a date: how many lie in a window, which page of a window a
cursor names, and up to which date it has data. It gives no more than ``cap`` records for one query, so a window that holds
more is split, into years first and then in halves, down to a day; a day over the cap is read by its cursor, which has no
such bound. Each window is a partition, so windows are read at the same time and again if an executor is lost.

As a stream, an offset is the first date not yet read; a batch takes whole days, about ``cap`` records. Spark keeps
offsets in the query's checkpoint, so a restart goes on where it stopped, and a batch that was cut is read again from the
same dates. Records of a day that come in after the day was read are not seen: a service that back-fills is read in batch.

``FolderService`` answers from files, as the tests and queries need it: no network is at hand here. Another service is a
class with the same three methods, named by the option ``service`` as ``module:Class``.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class FolderService:
    """Records as JSON lines in a folder per day, as ``publish`` writes them; ``page_size`` records a page.

    The folder must be one that the driver and all executors share.
    """

    def __init__(self, path: str, page_size: int = 100) -> None:
        self.path, self.page_size = unquote(urlparse(path).path), page_size

    def _files(self, day: date) -> list[str]:
        folder = f"{self.path}/day={day}"
        return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")) if os.path.isdir(folder) else []

    def _days(self) -> list[date]:
        return sorted(date.fromisoformat(d.removeprefix("day=")) for d in os.listdir(self.path) if d.startswith("day=") and d[4:5].isdigit())

    def until(self) -> date | None:
        """The first date after all data."""
        days = self._days()
        return days[-1] + timedelta(days=1) if days else None

    def count(self, start: date, end: date) -> int:
        n = 0
        for day in self._days():
            if start <= day < end:
                for file in self._files(day):
                    with open(file, "rb") as lines:
                        n += sum(chunk.count(b"\n") for chunk in iter(lambda: lines.read(1 << 20), b""))  # noqa: B023
        return n

    def page(self, start: date, end: date, cursor: str | None) -> tuple[list[dict], str | None]:
        """(records, cursor of the next page, None at the end); a cursor names a day, a file of it and a place there."""
        days = [d for d in self._days() if start <= d < end]
        at, file, byte = (cursor or f"{days[0]}:0:0").split(":") if days else ("", "0", "0")
        records: list[dict] = []
        for day in [d for d in days if str(d) >= at]:
            files = self._files(day)
            for i in range(int(file) if str(day) == at else 0, len(files)):
                with open(files[i], "rb") as lines:
                    lines.seek(int(byte) if str(day) == at and i == int(file) else 0)
                    while line := lines.readline():
                        records.append(json.loads(line))
                        if len(records) == self.page_size:
                            return records, f"{day}:{i}:{lines.tell()}"
        return records, None


def publish(records: DataFrame, day: str, path: str) -> None:
    """``records`` as a folder that ``FolderService`` answers from; rows without a day are left out, as no window holds them."""
    dated = records.where(F.col(day).isNotNull()).withColumn("day", F.date_format(day, "yyyy-MM-dd"))
    dated.repartition("day").write.mode("append").partitionBy("day").option("ignoreNullFields", "false").json(path)


@dataclass
class Window(InputPartition):
    start: date
    end: date


def windows(count, start: date, end: date, cap: int) -> Iterator[Window]:
    """Windows of at most ``cap`` records, or of one day; those without records are left out."""
    n = count(start, end)
    if n == 0:
        return
    if n <= cap or (end - start).days <= 1:
        yield Window(start, end)
        return
    turns = [date(y, 1, 1) for y in range(start.year + 1, end.year + 1) if start < date(y, 1, 1) < end]
    cuts = [start, *(turns or [start + (end - start) // 2]), end]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield from windows(count, a, b, cap)


def _service(options: dict):
    module, _, name = options.get("service", f"{__name__}:FolderService").partition(":")
    return getattr(importlib.import_module(module), name)(options["path"], int(options.get("pageSize", 100)))


class _Pages:
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, dict(options)

    def read(self, partition: Window | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        service, cursor, schema = _service(self.options), None, to_arrow_schema(self.schema)
        while True:
            records, following = service.page(partition.start, partition.end, cursor)
            if records:
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in records], schema)
            if following is None:
                return
            if following == cursor:
                raise ValueError(f"the service's next page is the page itself: {cursor}")
            cursor = following


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Window]:
        service = _service(self.options)
        end = service.until()
        if end is None:
            return []
        start = date.fromisoformat(self.options.get("start", "2000-01-01"))
        end = min(end, date.fromisoformat(self.options.get("end", "9999-12-31")))
        return list(windows(service.count, start, end, int(self.options.get("cap", 10_000)))) if start < end else []


class PagedStream(_Pages, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options)
        self.first = options.get("start", "2000-01-01")
        self.at = date.fromisoformat(self.first)

    def initialOffset(self) -> dict:
        return {"day": self.first}

    def latestOffset(self) -> dict:
        """The end of the next batch: as many whole days as the cap allows, one at least."""
        service, cap = _service(self.options), int(self.options.get("cap", 10_000))
        end = service.until()
        if end is None or end <= self.at:
            return {"day": self.at.isoformat()}
        while (end - self.at).days > 1 and service.count(self.at, end) > cap:
            end = self.at + (end - self.at) // 2
        self.at = end
        return {"day": end.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        a, b = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        self.at = max(self.at, b)  # after a restart Spark plans the batches that it knows of first
        return list(windows(_service(self.options).count, a, b, int(self.options.get("cap", 10_000)))) if a < b else []

    def commit(self, end: dict) -> None:
        self.at = max(self.at, date.fromisoformat(end["day"]))


class PagedSource(DataSource):
    """Format ``paged``. Options: path, service, pageSize, cap, start and end (dates, end not included). A schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(schema, self.options)
