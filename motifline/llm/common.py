"""Small helpers of the training-data operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_of(spark: SparkSession) -> int:
    """Number of shuffle partitions, which the session sizes with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(docs: DataFrame, used: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `run` makes of `docs`, with columns that it doesn't use out of reach of its own names.

    `run` returns the columns it was given, in their order.
    """
    hidden = docs.toDF(*[c if c in used else f"_other_{i}" for i, c in enumerate(docs.columns)])
    return run(hidden).toDF(*docs.columns)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects garbage, once listeners have let go of the plans."""
    for _ in range(2):
        time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_column(
    df: DataFrame, keep: Sequence[str], column: str, make: Callable[[], Callable[[Any], tuple]], fields: str
) -> DataFrame:
    """The columns `keep` unchanged, and `fields` computed from the values of `column`.

    `make` builds the function once in each task. Kept columns pass as Arrow arrays,
    so nulls and large numbers stay as they are.
    """
    new = T.StructType.fromDDL(fields)
    types = [to_arrow_type(f.dataType) for f in new]
    names = [*keep, *new.names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches):
            rows = [f(x) for x in b.column(len(keep)).to_pylist()]
            made = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=names)

    schema = T.StructType([*[df.schema[c] for c in keep], *new])
    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{column}` as _value").mapInArrow(task, schema)
