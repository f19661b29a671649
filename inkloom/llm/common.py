"""Helpers shared by the training-data operators: table reading and Arrow row mapping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine, where none is set, one below Spark's own local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "inkloom-checkpoint")
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for a written intermediate table; it is deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: T.StructType) -> DataFrame:
    """Each row of df through a Python function that yields output tuples.

    ``make`` runs once per task and returns the row function, so models and automata are built
    once per task. Rows cross in Arrow batches; the columns of df are the function's arguments.
    """
    arrow_schema = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                rows: list[tuple] = []
                for args in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    rows.extend(fn(*args))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow_schema, strict=True)], names=names)

    return df.mapInArrow(run, schema)
