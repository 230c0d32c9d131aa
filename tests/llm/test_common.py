from __future__ import annotations

import pyarrow as pa
from helpers import texts
from pyspark.sql import functions as F
from weftline.llm import common
from weftline.llm.common import Memory, bounded_batches, held_for, in_files, running


def test_memory_is_bounded_by_bytes():
    held = Memory(10_000)
    for i in range(1000):
        assert held.keep(i, b"x" * 50, 80) == b"x" * 50
        assert len(held) * 280 <= 10_000 and held[i] == b"x" * 50
    assert 0 < len(held) < 36


def test_a_worker_forgets_other_operators():
    held_for("one")["x"] = 1
    assert held_for("one") == {"x": 1}
    assert held_for("two") == {} and held_for("one") == {}


def test_batches_are_bounded_in_rows_and_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    bounded_batches(spark)
    few = texts(spark, *["y" * 2_000_000] * 12).coalesce(1).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in few) == 12 and max(r.bytes for r in few) <= common.BATCH_BYTES + 2_100_000
    many = spark.range(5000).coalesce(1).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in many) == 5000 and max(r.n for r in many) <= common.BATCH_ROWS


def test_small_tables_are_written_in_few_files(spark):
    wide = spark.range(0, 1000, 1, 50)
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(in_files(wide, 1000)) == 8 and parts(in_files(wide, 10_000_000)) == 50


def test_running_keeps_its_state_over_chunks(spark):
    frame = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "v array<int>")
    step = lambda state, x: (state + x, state)
    for r in frame.select("v", running(F.col("v"), F.lit(5), "int", step).alias("sums")).collect():
        assert r.sums == [5 + sum(r.v[:i]) for i in range(len(r.v))]
