"""Line-aligned corpora as a format of Spark's own: ``spark.read.format("aligned_lines")``.

A corpus is a folder with ``<split>/<lang>.<split>`` for each split and language, each a text file or a folder of part files in the order
of their names. A file is a partition; those of other languages and splits than the filters ask for are never opened, and reading ends
at the last row asked for. Files are opened by Arrow's file systems, so their store must be one of these (local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "split string, lang string, row int, text string"
#: Rows of a batch.
BATCH_ROWS = 10_000


class OneFile(InputPartition):
    """A language of a split, and the rows that are wanted of it."""

    def __init__(self, split: str, lang: str, files: list[str], first: int, end: int | None):
        self.split, self.lang, self.files, self.first, self.end = split, lang, files, first, end


class AlignedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.allowed = options["path"], {"split": None, "lang": None}
        for name, option in (("split", "split"), ("lang", "langs")):
            if options.get(option):
                self.allowed[name] = {x.strip() for x in options[option].split(",")}
        self.first, self.end = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists on ``split`` and ``lang``, and bounds on ``row``; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            if name in self.allowed and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = values if self.allowed[name] is None else self.allowed[name] & values
            elif name == "row" and isinstance(f.value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.end = end if self.end is None else min(self.end, end)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        out = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            split = folder.base_name
            if folder.type != fs.FileType.Directory or self.allowed["split"] is not None and split not in self.allowed["split"]:
                continue
            for found in sorted(store.get_file_info(fs.FileSelector(folder.path)), key=lambda x: x.base_name):
                lang, _, end = found.base_name.rpartition(".")
                if end != split or not lang or self.allowed["lang"] is not None and lang not in self.allowed["lang"]:
                    continue
                parts = [found] if found.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(found.path)), key=lambda x: x.base_name)
                files = [p.path for p in parts if p.type == fs.FileType.File and not p.base_name.startswith((".", "_"))]
                out.append(OneFile(split, lang, files, self.first, self.end))
        return out or [OneFile("", "", [], 0, 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        held: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            rows, texts = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([partition.split] * len(rows)), pa.array([partition.lang] * len(rows)), pa.array(rows, pa.int32()), pa.array(texts, pa.string())], ["split", "lang", "row", "text"])

        for row, text in self._lines(store, partition):
            held.append((row, text))
            if len(held) == BATCH_ROWS:
                yield batch()
        if held:
            yield batch()

    @staticmethod
    def _lines(store: fs.FileSystem, partition: OneFile) -> Iterator[tuple[int, str]]:
        """(row, line) of a partition's files, one after the other; lines end at \\n or \\r\\n."""
        row = 0
        for path in partition.files:
            with store.open_input_stream(path, compression=None) as stream:
                rest = b""
                while partition.end is None or row < partition.end:
                    block = stream.read(1 << 20)
                    *lines, rest = (rest + block).split(b"\n") if block else ([rest] if rest else []) + [b""]
                    for line in lines:
                        if row >= partition.first and (partition.end is None or row < partition.end):
                            yield row, line.removesuffix(b"\r").decode("utf-8", "replace")
                        row += 1
                    if not block:
                        break


class AlignedLines(DataSource):
    """Options: ``path``, and ``split`` and ``langs`` (names with commas between them) where only some are wanted."""

    @classmethod
    def name(cls) -> str:
        return "aligned_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AlignedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AlignedLines)
