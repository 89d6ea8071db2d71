"""Files parsed into layout elements and text-layer tables, as a data source for batches and streams."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A row is an element or a table, of which it has page, number (idx) and cells; or a file that the parser failed at.
SCHEMA = (
    "record string, path string, doc_id string, idx int, page int, category string, text string, text_as_html string, image_base64 string, "
    "image_mime_type string, rows array<array<string>>, parse_error string"
)
_FIELDS = ("page", "category", "text", "text_as_html", "image_base64", "image_mime_type")
#: bytes to elements, or to (elements, tables): dicts with the fields above, tables with page and rows
Parser = Callable[..., list[dict] | tuple[list[dict], list[dict]]]


@dataclass
class Files(InputPartition):
    """Files of one task: (path, size, time of change in ns)."""

    files: list[tuple[str, int, int]]


def _listed(folder: str, glob: str) -> list[tuple[str, int, int]]:
    """The files of a folder and those below it, by path; names that begin with a dot or an underscore are left out."""
    system, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and fnmatch(f.base_name, glob))


def packed(files: list[tuple[str, int, int]], size: int) -> list[Files]:
    """Files dealt to tasks: in order, until a task has `size` bytes; a larger file is a task by itself."""
    out: list[Files] = []
    room = 0
    for f in files:
        if not out or f[1] > room:
            out.append(Files([]))
            room = size
        out[-1].files.append(f)
        room -= f[1]
    return out


class _Parsing:
    """What readers of batches and of streams share. Options: path; glob (*.pdf); taskBytes (64 MB); others go to the parser."""

    def __init__(self, parser: Parser, options: dict[str, str]) -> None:
        own = {k.lower(): v for k, v in options.items()}
        self.parser, self.folder, self.glob = parser, own.pop("path"), own.pop("glob", "*.pdf")
        self.size, self.log, self.options = int(own.pop("taskbytes", 64 << 20)), own.pop("log", None), own

    def read(self, partition: Files) -> Iterator[tuple]:
        system = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pafs.LocalFileSystem()
        for path, size, time in partition.files:
            doc = hashlib.sha256(f"{path}\n{size}\n{time}".encode()).hexdigest()[:32]
            elements, tables, error = [], [], None
            try:
                with system.open_input_stream(path) as f:
                    got = self.parser(f.read(), **self.options)
                elements, tables = got if isinstance(got, tuple) else (got, [])
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            if error is not None:
                yield ("error", path, doc, *[None] * 8, error)
            for i, e in enumerate(elements):
                yield ("element", path, doc, i, *[e.get(c) for c in _FIELDS], None, None)
            number: dict[int, int] = {}
            for t in tables:
                n = number[t["page"]] = number.get(t["page"], -1) + 1
                yield ("table", path, doc, n, t["page"], *[None] * 5, t["rows"], None)


class _Batch(_Parsing, DataSourceReader):
    def partitions(self) -> list[Files]:
        # a reader without partitions would be asked for one
        return packed(_listed(self.folder, self.glob), self.size) or [Files([])]


class _Stream(_Parsing, DataSourceStreamReader):
    """Each file once, and again when it has changed. The option `log` names a folder in which files
    are written down as they are found, numbered by discovery; an offset is the number of entries that
    count. So offsets stay short, files may have any time of change, and a restart knows all that were seen."""

    def _entries(self, start: int, end: int) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        system, root = self._log()
        for n in range(start, end):
            with system.open_input_stream(f"{root}/{n}.json") as f:
                out += [tuple(x) for x in json.loads(f.read())]
        return out

    def _log(self) -> tuple[pafs.FileSystem, str]:
        if not self.log:
            raise ValueError("a stream of layouts needs the option log, a folder for the files it has seen")
        system, root = pafs.FileSystem.from_uri(self.log) if "://" in self.log else (pafs.LocalFileSystem(), self.log)
        system.create_dir(root, recursive=True)
        return system, root

    def _count(self) -> int:
        system, root = self._log()
        return sum(f.base_name.endswith(".json") for f in system.get_file_info(pafs.FileSelector(root)))

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        n = self._count()
        if not hasattr(self, "seen"):
            self.seen = set(self._entries(0, n))
        if fresh := [f for f in _listed(self.folder, self.glob) if f not in self.seen]:
            system, root = self._log()
            # whole or not at all: the entry counts by its name
            with system.open_output_stream(f"{root}/{n}.part") as f:
                f.write(json.dumps(fresh).encode())
            system.move(f"{root}/{n}.part", f"{root}/{n}.json")
            self.seen |= set(fresh)
            n += 1
        return {"entries": n}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return packed(sorted(self._entries(start["entries"], end["entries"])), self.size)


def register_layout(spark: SparkSession, parser: Parser, name: str = "layout") -> None:
    """Make spark.read.format(name) and spark.readStream.format(name) parse files with `parser`, which goes to the tasks with the plan.

    The source reads what pyarrow's file systems reach. A file is parsed whole, in one task, once
    for its elements and its tables; a file that the parser fails at is a row of record `error`.
    """

    class Layout(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> DataSourceReader:
            return _Batch(parser, dict(self.options))

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return _Stream(parser, dict(self.options))

    spark.dataSource.register(Layout)


def elements_of(rows: DataFrame) -> DataFrame:
    """The elements among a source's rows, as chunk_documents takes them."""
    return rows.where("record = 'element'").select("doc_id", "idx", *_FIELDS)


def tables_of(rows: DataFrame) -> DataFrame:
    """The text layer's tables among a source's rows, as chunk_documents takes them."""
    return rows.where("record = 'table'").select("doc_id", "page", F.col("idx").alias("n"), "rows")
