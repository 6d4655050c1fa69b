"""Sitemap snapshots as a data source: ``spark.read.format("sitemap_snapshots")`` and the same as a stream."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError, XMLPullParser

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

log = logging.getLogger(__name__)

NAME = "sitemap_snapshots"
#: Files of a partition, and bytes that a reader holds of a file at once.
FILES, CHUNK = 8, 1 << 20
_PROLOGUE = re.compile(rb"<\?xml.*?\?>|<!DOCTYPE[^>]*>", re.S)


@dataclass
class _Files(InputPartition):
    """Some files of snapshots: (snapshot, address)."""

    files: list[tuple[int, str]]


class _Snapshots:
    """Directories ``snapshot=1``, ``snapshot=2`` and so on of XML files, wherever the Arrow file systems reach from all tasks."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the option path names the folder of the snapshots")
        self.path, self.rules = options["path"].rstrip("/"), json.loads(options.get("rules", "[]"))
        self.per_partition = int(options.get("files", FILES))

    def _held(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        held, path = self._held()
        names = [f.base_name for f in held.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        return sorted(int(n[9:]) for n in names if re.fullmatch(r"snapshot=\d+", n))

    def partitions(self, numbers: list[int]) -> list[_Files]:
        from pyarrow import fs

        held, path = self._held()
        files = [(n, f.path) for n in numbers for f in sorted(held.get_file_info(fs.FileSelector(f"{path}/snapshot={n}")), key=lambda f: f.path) if f.is_file and f.size and not f.base_name.startswith((".", "_"))]
        return [_Files(files[k : k + self.per_partition]) for k in range(0, len(files), self.per_partition)] or [_Files([])]

    def locations(self, path: str) -> Iterator[str]:
        """The addresses of a file's sitemaps, one after the other; what follows a place that is no XML is left out."""
        parser, held = XMLPullParser(["end"]), self._held()[0]
        parser.feed(b"<all>")
        rest = b""
        with held.open_input_stream(path) as f:
            while True:
                block = f.read(CHUNK)
                rest += block
                at = rest.rfind(b">") + 1 if block else len(rest)
                try:
                    parser.feed(_PROLOGUE.sub(b"", rest[:at]) + (b"" if block else b"</all>"))
                    for _, e in parser.read_events():
                        if e.tag.rpartition("}")[2] == "loc" and (e.text or "").strip():
                            yield e.text.strip()
                        elif e.tag.rpartition("}")[2] in ("url", "sitemap"):
                            e.clear()
                except ParseError as x:
                    log.warning("%s: %s", path, x)
                    return
                rest = rest[at:]
                if not block:
                    return

    def section(self, url: str) -> str | None:
        return next((s for part, s in self.rules if part in url), None)

    def rows(self, partition: _Files, wanted: str | None = None) -> Iterator[tuple]:
        for number, path in partition.files:
            for k, url in enumerate(self.locations(path)):
                section = self.section(url)
                if wanted is None or section == wanted:
                    yield (number, path.rpartition("/")[2], k, url, section)


class _Reader(DataSourceReader):
    """Leaves out snapshots that filters exclude before their files are listed, and other sections while it reads."""

    def __init__(self, snapshots: _Snapshots):
        self.snapshots, self.tests, self.wanted = snapshots, [], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tell = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        for f in filters:
            if type(f) in tell and f.attribute == ("snapshot",):
                self.tests.append((tell[type(f)], int(f.value)))
            elif isinstance(f, EqualTo) and f.attribute == ("section",) and self.wanted is None:
                self.wanted = f.value
            else:
                yield f

    def partitions(self) -> list[_Files]:
        return self.snapshots.partitions([n for n in self.snapshots.numbers() if all(getattr(n, t)(v) for t, v in self.tests)])

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.snapshots.rows(partition, self.wanted)


class _StreamReader(DataSourceStreamReader):
    """An offset is the number of the last snapshot that was read: a batch reads those behind it, each once."""

    def __init__(self, snapshots: _Snapshots):
        self.snapshots = snapshots

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        return {"snapshot": max(self.snapshots.numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return self.snapshots.partitions([n for n in self.snapshots.numbers() if start["snapshot"] < n <= end["snapshot"]])

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.snapshots.rows(partition)


class SitemapSnapshots(DataSource):
    """Options: path, the folder of the snapshots; rules, [part of an address, section] pairs as JSON; files, per partition.

    A row an entry: snapshot, file, ord (its place in the file), url and section (null if no rule fits). Repeats stay. A
    snapshot must be complete when its directory appears, as a stream reads it once.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "snapshot bigint, file string, ord int, url string, section string"

    def reader(self, schema) -> _Reader:
        return _Reader(_Snapshots(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_Snapshots(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SitemapSnapshots)
