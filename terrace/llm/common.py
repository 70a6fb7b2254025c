"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, wherever an operator counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only a session on a single machine may lack
    it, as in tests; it then has a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    return _folder()


@cache
def _folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-terrace-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    schema = df.schema
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def counted(df: DataFrame, name: str, condition: Column | bool = True) -> tuple[DataFrame, int]:
    """``df`` written and read back, and how many of its rows meet a condition, counted as they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(F.lit(condition) if isinstance(condition, bool) else condition).alias("n")), name)
    return out, seen.get["n"]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most so many rows at once to Python: for wide rows, whose batches both sides hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def plain(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed to ``_0``, ``_1`` and so on, and what the named ones are called then; ``restored`` undoes it."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]), [f"_{docs.columns.index(n)}" for n in names]


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame that descends from ``plain(docs)``."""
    return df.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


#: Texts that a task has in hand as Python objects.
ROWS = 500
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_type(name: str) -> pa.DataType:
    return pa.list_(arrow_type(name[6:-1])) if name.startswith("array<") else ARROW[name]


def columns(shape: str) -> list[tuple[str, str]]:
    """Names and types of ``a long, b string`` and the like."""
    return [tuple(c.split()) for c in shape.split(", ")]


def per_text(docs: DataFrame, kept: Sequence[str], compute: Callable[[list[str | None]], Sequence[Any]], shape: str) -> DataFrame:
    """The ``kept`` columns of ``docs`` and, in ``shape``, the columns that ``compute`` gives for a list of texts.

    Texts alone are turned into Python objects, ``ROWS`` at a time: ids and other kept
    columns go through as they are, with nulls and all their digits.
    """
    made = columns(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            found = compute(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], *(v if isinstance(v, pa.Array) else pa.array(v, arrow_type(t)) for v, (_, t) in zip(found, made))], names=[*kept, *(n for n, _ in made)]
            )

    schema = T.StructType([*(docs.schema[k] for k in kept), *T.StructType.fromDDL(shape).fields])
    return only(docs, *kept, "text").mapInArrow(run, schema)


def salted_lookup(rows: DataFrame, named: DataFrame, key: str, count: str, spread: int = 64) -> DataFrame:
    """``rows`` joined with ``named``, which has one row for each ``key`` and how many of ``rows`` have it (``count``).

    A key with over a thousandth of all rows is dealt to ``spread`` tasks; there are
    less than a thousand of these, so their list may be broadcast.
    """
    least = (named.agg(F.sum(count)).first()[0] or 0) // 1000
    salts = F.sequence(F.lit(0), F.when(F.col(count) > least, spread - 1).otherwise(0))
    hot = named.where(F.col(count) > least).select(F.col(key).alias("_hot"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    right = named.withColumn("_of", F.explode(salts)).withColumnRenamed(key, "_key").drop(count)
    return left.join(right, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_of"))).drop("_key", "_salt", "_of")
