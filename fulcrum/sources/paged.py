"""A data source over cursor-paged JSON dumps: ``spark.read.format("paged_json")``.

A dump is a folder of pages, each ``{"results": [...], "meta": {"next_cursor": name or null}}``
in a file of the cursor's name; reading starts at ``first.json`` and follows the
cursors, one partition a page.  The cursors are followed once, on the driver, a page at a
time; a dump with an ``index.json``, ``{"pages": [names]}``, spares that.  Paths are those of
any file system that pyarrow opens.  Comparisons on plain columns are taken over from
the plan and applied while a page is parsed.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.names, self.path, self.tests = schema.names, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            test = _TESTS.get(type(f))
            if test is not None and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], test, f.value))
            else:
                yield f

    def _page(self, name: str) -> dict | None:
        """A page's content; None if there is none of that name."""
        if "://" in self.path:
            files, path = fs.FileSystem.from_uri(f"{self.path}/{name}.json")
        else:
            files, path = fs.LocalFileSystem(), f"{self.path}/{name}.json"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        index = self._page("index")
        if index is not None:
            return [InputPartition(p) for p in index["pages"]]
        pages, seen, at = [], set(), "first"
        while at and at not in seen and (page := self._page(at)) is not None:
            pages.append(at)
            seen.add(at)
            at = page.get("meta", {}).get("next_cursor") if page.get("results") else None
        return [InputPartition(p) for p in pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = (self._page(partition.value) or {}).get("results", [])
        for r in rows:
            if all(r.get(c) is not None and test(r[c], v) for c, test, v in self.tests):
                yield tuple(r.get(n) for n in self.names)


class PagedJson(DataSource):
    """Options: ``path``; the schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options["path"])
