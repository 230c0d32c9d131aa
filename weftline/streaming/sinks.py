"""A sink that a stream can be stopped at and started again, and what it holds: rows, errors and the keys that are done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(results: DataFrame, folder: str, error: str = "error") -> StreamingQuery:
    """Writes a stream of results to folder until there is no more to read. A row whose error isn't null is one.

    A batch is one table under its number, with its rows, errors and keys together: it is there whole or not at all, and a batch that is
    done again after a stop takes its own place. So no row is lost and none comes twice.
    """
    if error not in results.columns:
        raise ValueError(f"no column {error}")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = results.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    return writer.start()


def sunk(spark: SparkSession, folder: str, keys: Sequence[str], error: str = "error") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, errors, done keys) of what a resumable sink holds: rows without their error, errors as keys and message."""
    all_ = spark.read.parquet(f"{folder}/out").drop("batch")
    return all_.filter(F.col(error).isNull()).drop(error), all_.filter(F.col(error).isNotNull()).select(*keys, error), all_.select(*keys).distinct()


def dropped_from(spark: SparkSession, folder: str, batch: int) -> None:
    """Takes the batches from a number on out of a sink, as before a run that does them again with a checkpoint of its own."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(place):
        name = found.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) >= batch:
            fs.delete(found.getPath(), True)
