"""Vendor formats as Spark data sources: declared columns, every file's header compared, rows that don't fit given with reasons.

A format is declared, not programmed: its columns' headers, names, kinds and
bounds.  Files are read in ranges of bytes, so a large one is spread over tasks;
each task looks at the header of its file.  The same source is streamed: files
whose names come after those seen are new, as capture names ascend.  Files are
opened by pyarrow, so folders are paths or addresses that it reads.
"""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

KINDS = {"text": (T.StringType(), pa.string()), "whole": (T.LongType(), pa.int64()), "number": (T.DoubleType(), pa.float64()), "instant": (T.TimestampType(), pa.timestamp("us", "UTC"))}
#: Bytes of a task's part of a file; rows that are given on at once.
SPLIT, PORTION = 64 << 20, 4096


@dataclass(frozen=True)
class Field:
    """A column: its header, the name and kind that it gets, whether it may be empty, and bounds of numbers."""

    header: str
    name: str
    kind: str = "text"
    required: bool = False
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Format:
    """A vendor's format: columns in the file's order, constants that every row gets, and the sign between columns."""

    name: str
    fields: tuple[Field, ...]
    constants: tuple[tuple[str, str], ...] = ()
    delimiter: str = ","

    @property
    def schema(self) -> T.StructType:
        """The fields, the constants, and where each row stands: _file, _offset (its first byte) and _reasons, empty for a row that fits."""
        own = [T.StructField(f.name, KINDS[f.kind][0]) for f in self.fields] + [T.StructField(name, T.StringType()) for name, _ in self.constants]
        return T.StructType([*own, T.StructField("_file", T.StringType()), T.StructField("_offset", T.LongType()), T.StructField("_reasons", T.ArrayType(T.StringType()))])

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Format:
        given = json.loads(text)
        return cls(given["name"], tuple(Field(**f) for f in given["fields"]), tuple(map(tuple, given["constants"])), given["delimiter"])

    def check_header(self, path: str, found: list[str]) -> None:
        wanted = [f.header for f in self.fields]
        if found != wanted:
            missing, more = sorted(set(wanted) - set(found)), sorted(set(found) - set(wanted))
            raise ValueError(f"{path}: header of another format than {self.name}: missing {missing}, unexpected {more}" if missing or more else f"{path}: header order differs: {found}")

    def values(self, cells: list[str]) -> tuple[list[object], list[str]]:
        """The row's values, and why it doesn't fit."""
        if len(cells) != len(self.fields):
            return [None] * len(self.fields), [f"{len(cells)} columns"]
        out, reasons = [], []
        for f, cell in zip(self.fields, cells, strict=True):
            value, why = f_value(f, cell.strip())
            out.append(value)
            reasons += [why] if why else []
        return out, reasons


def f_value(field: Field, cell: str) -> tuple[object, str | None]:
    """A cell as its field's kind, or why it can't be."""
    if not cell:
        return None, f"{field.name} is empty" if field.required else None
    try:
        value = {"text": str, "whole": int, "number": float, "instant": datetime.fromisoformat}[field.kind](cell)
    except ValueError:
        return None, f"{field.name} is no {field.kind}"
    if field.kind in ("whole", "number") and (not math.isfinite(value) or (field.least is not None and value < field.least) or (field.most is not None and value > field.most)):
        return None, f"{field.name} is out of bounds"
    if field.kind == "whole" and not -(1 << 63) <= value < 1 << 63:
        return None, f"{field.name} is out of bounds"
    return value, None


@dataclass
class Part(InputPartition):
    """A range of bytes of a file."""

    path: str
    start: int
    end: int


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a folder's files, or of the file itself, in order."""
    store, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(top)
    every = [info] if info.is_file else store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in every if f.is_file and not f.base_name.startswith((".", "_")))


def _parts(files: list[tuple[str, int]], split: int) -> list[Part]:
    return [Part(path, at, min(at + split, size)) for path, size in files for at in range(0, max(size, 1), split)]


def _rows(part: Part, form: Format) -> Iterator[pa.RecordBatch]:
    """The rows that begin in a part; a row is a line."""
    store, path = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
    names, schema = form.schema.names, pa.schema([(f.name, KINDS[f.kind][1]) for f in form.fields])
    for name, _ in form.constants:
        schema = schema.append(pa.field(name, pa.string()))
    schema = schema.append(pa.field("_file", pa.string())).append(pa.field("_offset", pa.int64())).append(pa.field("_reasons", pa.list_(pa.string())))
    constants = [v for _, v in form.constants]
    with store.open_input_file(path) as raw:
        file = io.BufferedReader(raw, 1 << 20)
        head = file.readline()
        form.check_header(part.path, [c.strip() for c in next(csv.reader([head.decode("utf-8-sig").rstrip("\r\n")], delimiter=form.delimiter), [])])
        at = len(head)
        if part.start > at:
            file.seek(part.start - 1)
            at = part.start - 1 + len(file.readline())  # the line that begins before belongs to the part before
        held: list[list[object]] = []
        while at < part.end:
            line = file.readline()
            if not line:
                break
            begin, at = at, at + len(line)
            if not line.strip():
                continue
            try:
                cells, why = next(csv.reader([line.decode("utf-8").rstrip("\r\n")], delimiter=form.delimiter, strict=True)), []
                values, why = form.values(cells)
            except (UnicodeDecodeError, csv.Error) as e:
                values, why = [None] * len(form.fields), [f"not readable: {type(e).__name__}"]
            held.append([*values, *constants, part.path, begin, why])
            if len(held) >= PORTION:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], names=names)


class _Batch(DataSourceReader):
    def __init__(self, path: str, form: Format, split: int) -> None:
        self.path, self.form, self.split = path, form, split

    def partitions(self) -> list[Part]:
        return _parts(_files(self.path), self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.form)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, form: Format, split: int) -> None:
        self.path, self.form, self.split = path, form, split

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max((p for p, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts([(p, n) for p, n in _files(self.path) if start["after"] < p <= end["after"]], self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.form)


class FormatSource(DataSource):
    """Options: path, form (Format.dumps), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_format"

    def _given(self) -> tuple[str, Format, int]:
        return self.options["path"], Format.loads(self.options["form"]), int(self.options.get("split", SPLIT))

    def schema(self) -> T.StructType:
        return self._given()[1].schema

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(*self._given())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._given())


#: Declared formats by name; a name is taken once.
FORMATS: dict[str, Format] = {}


def declare(form: Format) -> Format:
    if FORMATS.get(form.name, form) != form:
        raise ValueError(f"format {form.name} is declared already")
    FORMATS[form.name] = form
    return form


def read_format(spark: SparkSession, name: str, path: str, split: int = SPLIT) -> DataFrame:
    """The rows of a folder's files in a declared format, or of a file; those that don't fit have reasons."""
    spark.dataSource.register(FormatSource)
    return spark.read.format("tidemark_format").option("form", FORMATS[name].dumps()).option("split", split).load(path)


def stream_format(spark: SparkSession, name: str, path: str, split: int = SPLIT) -> DataFrame:
    """The same as a stream of the files that come; names must ascend, as those of captures do."""
    spark.dataSource.register(FormatSource)
    return spark.readStream.format("tidemark_format").option("form", FORMATS[name].dumps()).option("split", split).load(path)
