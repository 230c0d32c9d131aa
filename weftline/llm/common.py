"""What the corpus operators share: lineage cuts, bounded Arrow batches, what a worker remembers, and text basics."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import remove, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
CHUNK = 128

__all__ = ["Memory", "batches_of", "bounded_batches", "checkpoint_dir", "cut", "held_for", "in_files", "let", "lower_ascii", "remove", "running", "text_bytes"]


def bounded_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch of texts small enough for a worker, in rows and in bytes; a session that sets its own sizes keeps them."""
    told = spark.conf.getAll
    for key, most in (("maxRecordsPerBatch", str(BATCH_ROWS)), ("maxBytesPerBatch", str(BATCH_BYTES))):
        if f"spark.sql.execution.arrow.{key}" not in told:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


class Memory(dict):
    """What is remembered to spare work, of at most so many bytes, in two generations.

    When the younger one is half of that, it becomes the older one, which goes. Who finds something in the older one keeps it again,
    so what comes up often stays.
    """

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.size, self.old = most_bytes // 2, 0, {}

    def keep(self, key, value, size: int):
        """size: of key and value, without what the table itself takes for an entry."""
        if self.size + size + 200 > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        self.size += size + 200
        return value


_held: dict[str, dict] = {}


def held_for(operator: str) -> dict:
    """What this worker process keeps from task to task for an operator. What it kept for others goes first, since workers outlive stages."""
    if operator not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        _held[operator] = {}
    return _held[operator]


def checkpoint_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def in_files(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in no more tasks than so many rows ask for, or 8, so that small tables are not written in a great many files. Large ones stay as they are."""
    return df.coalesce(max(8, -(-rows // each)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and written to the checkpoint folder, so that lost executors cost no recomputation. rows: a bound of its rows, if known."""
    checkpoint_dir(df.sparkSession)
    return (df if rows is None else in_files(df, rows)).checkpoint(eager=True)


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lower_ascii(column):
    """A-Z to a-z and nothing else. lower() folds other letters too, so it serves only texts that are ASCII throughout."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, start: Column, emits: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """For each of the items, in order, what step(state, item) emits beside the next state.

    Results are appended within chunks of CHUNK items, and then chunk by chunk, since appending copies an array.
    """
    made = f"cast(array() as array<{emits}>)"

    def one(acc: Column, x: Column) -> Column:
        state, emitted = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(emitted)).alias("out"))

    def chunk(acc: Column, of: Column) -> Column:
        done = F.aggregate(of, F.struct(acc["state"].alias("state"), F.expr(made).alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    def all_(held: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int")), lambda k: F.slice(held, k * CHUNK + 1, F.lit(CHUNK)))
        zero = F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{emits}>>)").alias("outs"))
        return F.when(F.size(held) > 0, F.flatten(F.aggregate(chunks, zero, chunk, lambda acc: acc["outs"]))).otherwise(F.expr(made))

    return let(items, all_)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows, and of not much more than so many bytes in binary and string cells."""
    held: list[tuple] = []
    size = 0
    sized = [i for i, f in enumerate(schema) if pa.types.is_binary(f.type) or pa.types.is_string(f.type) or pa.types.is_list(f.type)]
    for row in rows:
        held.append(row)
        size += sum(len(row[i]) for i in sized if row[i] is not None)
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
