"""Sensor files in CSV."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from csv import reader
from dataclasses import dataclass
from io import TextIOWrapper
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyarrow.csv import ConvertOptions, ReadOptions
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

# Column names that mark time and bookkeeping columns in the files.
TIME_COLUMNS = ("DATETIME", "datetime", "Date", "Time", "timestamp")
GROUPED_META = ("datetime", "changepoint", "source_group", "source_file")


CONVERT = ConvertOptions(strings_can_be_null=True, null_values=[""])


def _read(spark: SparkSession, paths: str | list[str], schema: T.StructType | None) -> DataFrame:
    read = spark.read.option("header", True)
    return (read.schema(schema) if schema else read.option("inferSchema", True)).csv(paths)


def read_single_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return _read(spark, path, schema)


@dataclass
class Share(InputPartition):
    """The files of a folder whose name falls on `number` of `shares`."""

    folder: str
    number: int
    shares: int


class GroupedCsv(DataSource):
    """CSV files in folders, read with their columns matched by name.

    Options: root, groups (folder names, a line each), shares (tasks for a folder) and
    mode. Mode `heads` gives the columns of each file, `rows` the rows. Folders are listed
    and files opened in the tasks; any file system that Arrow knows will do.
    """

    @classmethod
    def name(cls) -> str:
        return "grouped_csv"

    def reader(self, schema: T.StructType) -> GroupedCsvReader:
        return GroupedCsvReader(dict(self.options), schema)


class GroupedCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.fields = options, schema

    def partitions(self) -> list[Share]:
        shares = int(self.options["shares"])
        return [Share(folder, i, shares) for folder in self.options["groups"].split("\n") for i in range(shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(self.options["root"])
        listed = files.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{partition.folder}", allow_not_found=True))
        for info in listed:
            mine = crc32(info.base_name.encode()) % partition.shares == partition.number
            if not mine or not info.is_file or not info.base_name.endswith(".csv"):
                continue
            with files.open_input_stream(info.path) as f:
                header = next(reader(TextIOWrapper(f, encoding="utf-8-sig", newline="")), None)
            if header:
                with files.open_input_stream(info.path) as f:
                    read = self._head if self.options["mode"] == "heads" else self._rows
                    yield from read(f, header, partition.folder, info.base_name)

    def _head(self, f: pa.NativeFile, header: list[str], folder: str, name: str) -> Iterator[pa.RecordBatch]:
        opened = _opened(f, header, CONVERT)
        kinds = [_kind(t) for t in opened.schema.types] if opened else ["void"] * len(header)
        columns = [[f"{folder}/{name}"] * len(header), list(range(len(header))), [c.strip() for c in header], kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to_arrow_schema(self.fields))

    def _rows(self, f: pa.NativeFile, header: list[str], folder: str, name: str) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.fields)
        wanted = {c: target.field(c.strip()).type for c in header if c.strip() in target.names}
        # Times without a zone count as UTC where a column is an instant.
        plain = {c: pa.timestamp("us") if pa.types.is_timestamp(t) and t.tz else t for c, t in wanted.items()}
        convert = ConvertOptions(column_types=plain, include_columns=list(wanted), strings_can_be_null=True, null_values=[""])
        for b in _opened(f, header, convert) or ():
            held = {c.strip(): col for c, col in zip(b.schema.names, b.columns)}
            held |= {c: pa.array([v] * b.num_rows) for c, v in (("source_group", folder), ("source_file", name))}
            columns = []
            for field in target:
                column = held.get(field.name, pa.nulls(b.num_rows, field.type))
                columns.append(pc.assume_timezone(column, "UTC") if column.type != field.type and pa.types.is_timestamp(field.type) else column)
            yield pa.RecordBatch.from_arrays(columns, schema=target)


def _opened(f: pa.NativeFile, header: list[str], convert: ConvertOptions) -> arrow_csv.CSVStreamingReader | None:
    """Reader of the rows below the header, None if there are none."""
    try:
        return arrow_csv.open_csv(f, ReadOptions(column_names=header, skip_rows=1), convert_options=convert)
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):
            return None
        raise


def _kind(t: pa.DataType) -> str:
    """Spark's name of a type that was found in a file; times of day and the like stay text."""
    try:
        return from_arrow_type(t, prefer_timestamp_ntz=True).simpleString()
    except Exception:
        return "string"


def _common(kinds: set[str]) -> T.DataType:
    """Type of a column from what its files hold."""
    kinds = kinds - {"void"}
    if len(kinds) != 1:
        kinds = {"double"} if kinds == {"bigint", "double"} else {"timestamp_ntz"} if kinds == {"date", "timestamp_ntz"} else {"string"}
    return T.StructType.fromDDL(f"c {kinds.pop()}")[0].dataType


def read_grouped_csv(
    spark: SparkSession, root: str, groups: Sequence[str] = ("valve1", "valve2"), schema: T.StructType | None = None
) -> DataFrame:
    """All `*.csv` files under the group folders, columns matched by name.

    Adds `source_group` (folder) and `source_file` (file name). Missing folders and empty
    files are skipped; no file with a header at all is an error. What comes to the driver is
    each column's name and types, not the files. `schema` gives the types of the columns
    by name; without it they are those of the first megabyte of each file, so give it
    where later values are of another kind. An empty field is null.
    """
    spark.dataSource.register(GroupedCsv)
    options = {"root": root, "groups": "\n".join(groups), "shares": str(spark.sparkContext.defaultParallelism)}
    source = lambda mode, fields: spark.read.format("grouped_csv").schema(fields).options(**options, mode=mode).load()
    heads = source("heads", "path string, place int, name string, kind string")
    found = heads.groupBy("name").agg(F.min(F.struct("path", "place")).alias("first"), F.collect_set("kind").alias("kinds")).orderBy("first").collect()
    if not found:
        raise ValueError(f"no CSV files under {root} in {', '.join(groups)}")
    given = {f.name: f.dataType for f in schema} if schema else {}
    types = [given.get(r.name, T.StringType()) if schema else _common(set(r.kinds)) for r in found]
    fields = [T.StructField(r.name, t) for r, t in zip(found, types)]
    return source("rows", T.StructType([*fields, *T.StructType.fromDDL("source_group string, source_file string")]))


def split_roles(
    df: DataFrame, meta_cols: Sequence[str], label_col: str, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Order the columns as meta, `label`, features and return the feature names.

    Names in `meta_cols` that the frame lacks are ignored; `keep` are further
    columns that are no features. A missing label column becomes 0.
    """
    meta = [c for c in [*meta_cols, *keep] if c in df.columns]
    features = [c for c in df.columns if c not in meta and c != label_col]
    label = F.coalesce(F.col(label_col), F.lit(0)) if label_col in df.columns else F.lit(0)
    return df.select(*meta, label.cast("int").alias("label"), *features), features
