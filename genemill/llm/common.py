"""What several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.session import ensure_checkpoint_dir

MAX_BROADCAST_BYTES = 64 << 20  # what is sent to every task is refused or split beyond this


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`, is 2; a null id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == 2


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Like `cut`, as a Parquet table: smaller than a checkpoint for wide tables of numbers."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array; null is empty."""
    return [v or b"" for v in values.cast(pa.large_binary()).to_pylist()]


def as_texts(values: pa.Array) -> list[str]:
    return [v or "" for v in values.to_pylist()]


SLICE = 256  # rows whose Python values a task holds at a time; a record batch can have ten thousand


def sliced(fn: Callable[..., pa.Array], *arrays: pa.Array) -> pa.Array:
    """`fn` over a few rows of the arrays at a time."""
    n = len(arrays[0])
    parts = [fn(*[a.slice(i, SLICE) for a in arrays]) for i in range(0, max(n, 1), SLICE)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, a few at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def add_by_slices(
    df: DataFrame, inputs: list[str], fields: list[T.StructField], fn: Callable[..., list[pa.Array]]
) -> DataFrame:
    """Add (or replace) columns: `fn` makes their arrays from the input arrays, a few rows at a time.

    What it makes leaves the task at once, so columns larger than their input do not gather there.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    columns = kept + [c for c in inputs if c not in kept]
    places = [columns.index(c) for c in inputs]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                new = fn(*[part.column(k) for k in places])
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))] + new, names=kept + names)

    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def rows_out(schema: pa.Schema, rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
