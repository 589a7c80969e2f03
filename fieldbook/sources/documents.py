"""Documents of many rows as Spark data sources: one head, rows, one end, and readers that stop at a limit of bytes.

`document` writes a column of text: each task its own file, and when all are done the driver puts the head before, the
end behind and the separators between them and moves them to their places; a write that failed leaves nothing.  The files
of the folder, end to end in the order of their names, are the document.  `csvdocument` and `jsondocument` read one back.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), as Spark's own are not open to Python tasks.

    spark.dataSource.register(Document); spark.dataSource.register(CsvDocument); spark.dataSource.register(JsonDocument)
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StringType, StructType

# fixed value: the most bytes of a body
MOST_BYTES = 8 * 1024 * 1024
CHUNK = 1 << 16


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[str]:
    """The files of a document in order."""
    from pyarrow import fs

    store, where = _at(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [where]
    found = store.get_file_info(fs.FileSelector(where))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.head, self.end, self.between = options.get("head", ""), options.get("end", ""), options.get("separator", "")
        self.draft = f"_draft-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, where = _at(self.path)
        store.create_dir(f"{where}/{self.draft}")
        part, name, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        with store.open_output_stream(f"{where}/{self.draft}/{name}") as out:
            for row in iterator:
                out.write(((self.between if n else "") + (row[0] or "")).encode())
                n += 1
        return Written(part, name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, where = _at(self.path)
        if _files(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        for old in _files(self.path):
            store.delete_file(old)
        place = 0

        def put(text: str) -> None:
            nonlocal place
            if text:
                with store.open_output_stream(f"{where}/{place:08d}") as out:
                    out.write(text.encode())
                place += 1

        put(self.head)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
        for i, m in enumerate(parts):
            put(self.between if i else "")
            store.move(f"{where}/{self.draft}/{m.name}", f"{where}/{place:08d}")
            place += 1
        put(self.end)
        store.delete_dir(f"{where}/{self.draft}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, where = _at(self.path)
        if store.get_file_info(f"{where}/{self.draft}").type.name == "Directory":
            store.delete_dir(f"{where}/{self.draft}")


class Document(DataSource):
    """Writer of a column of text; options head, end, separator."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, StringType):
            raise ValueError("a document is written from one column of text")
        return DocumentWriter(dict(self.options), overwrite)


class TooLong(ValueError):
    pass


class Bounded(io.RawIOBase):
    """The files end to end as one stream, which fails once it has given more than `most` bytes."""

    def __init__(self, store, files: list[str], most: int):
        self.store, self.left, self.files, self.now = store, most, list(files), None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.now is None:
                if not self.files:
                    return 0
                self.now = self.store.open_input_stream(self.files.pop(0))
            some = self.now.read(min(len(into), CHUNK))
            if some:
                break
            self.now.close()
            self.now = None
        self.left -= len(some)
        if self.left < 0:
            raise TooLong("a body longer than allowed")
        into[: len(some)] = some
        return len(some)


def _stream(path: str, most: int) -> io.TextIOWrapper:
    return io.TextIOWrapper(io.BufferedReader(Bounded(_at(path)[0], _files(path), most), CHUNK), encoding="utf-8", newline="")


class CsvReader(DataSourceReader):
    """One task reads the document in order: where its files were cut says nothing about its rows."""

    def __init__(self, options: dict, width: int):
        self.path, self.most, self.width = options["path"], int(options.get("mostbytes", MOST_BYTES)), width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = csv.reader(_stream(self.path, self.most), strict=True)
        head = next(rows, None)
        for row in rows:
            if len(row) != len(head):
                raise ValueError(f"a row of {len(row)} cells under a head of {len(head)}")
            yield tuple(x or None for x in row)


class CsvDocument(DataSource):
    """Reader of a CSV document by RFC 4180, columns named by its head; an empty cell is null.  Option mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "csvdocument"

    def schema(self) -> StructType:
        head = next(csv.reader(_stream(self.options["path"], int(self.options.get("mostbytes", MOST_BYTES)))), [])
        schema = StructType()
        for name in head:
            schema = schema.add(name, StringType())
        return schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return CsvReader(dict(self.options), len(schema.fields))


class JsonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most, self.key = options["path"], int(options.get("mostbytes", MOST_BYTES)), options.get("key", "resources")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The elements of the array under `key`, one by one: no more than an element and a chunk is held."""
        stream, decoder, held, eof = _stream(self.path, self.most), json.JSONDecoder(), "", False

        def more() -> None:
            nonlocal held, eof
            some = stream.read(CHUNK)
            eof, held = not some, held + some

        mark = json.dumps(self.key) + ":"
        while mark not in held.replace(": ", ":") and not eof:
            more()
        held = held.replace(f"{json.dumps(self.key)}: ", mark, 1)
        if mark not in held:
            raise ValueError(f"no {self.key}")
        held = held[held.index(mark) + len(mark) :].lstrip()
        if held[:1] != "[":
            raise ValueError(f"{self.key} is no array")
        held = held[1:]
        while True:
            held = held.lstrip(" \t\r\n,")
            if held[:1] == "]":
                break
            try:
                value, end = decoder.raw_decode(held)
                if end == len(held) and not eof:  # a number may go on
                    raise json.JSONDecodeError("more", held, end)
            except json.JSONDecodeError:
                if eof:
                    raise
                more()
                continue
            yield (json.dumps(value, ensure_ascii=False, separators=(",", ":")),)
            held = held[end:]
        while not eof:  # the rest counts as well
            held = ""
            more()


class JsonDocument(DataSource):
    """Reader of the elements of an array in a JSON document, as lines of JSON.  Options key, mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "jsondocument"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (Document, CsvDocument, JsonDocument):
        spark.dataSource.register(source)


def write(lines: DataFrame, path: str, head: str = "", end: str = "", separator: str = "", mode: str = "overwrite") -> None:
    """Writes the one column of `lines`, in order, as a document."""
    register(lines.sparkSession)
    lines.write.format("document").mode(mode).option("head", head).option("end", end).option("separator", separator).save(path)


def read_csv(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("csvdocument").option("mostBytes", most_bytes).load(path)


def read_json(spark: SparkSession, path: str, key: str = "resources", most_bytes: int = MOST_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("jsondocument").option("key", key).option("mostBytes", most_bytes).load(path)
