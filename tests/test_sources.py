from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from weftline.sources import files
from weftline.streaming import sinks


def test_tolerant_json_reads_indented_documents_and_sets_corrupt_ones_aside(spark, tmp_path):
    good = {"a": 1, "b": {"c": ["x", "y"]}}
    for name, text in {"one": json.dumps(good), "two": json.dumps(good, indent=1), "cut": json.dumps(good, indent=1)[:-4], "blank": " \n", "empty": "", "word": "no json", "more": json.dumps(good | {"z": 5}, indent=4)}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, bad = files.tolerant_json(spark, f"{tmp_path}/*.json", "a int, b struct<c:array<string>>")
    assert [(r.a, r.b.c) for r in rows.collect()] == [(1, ["x", "y"])] * 3
    assert sorted(os.path.basename(r.path) for r in bad.collect()) == ["blank.json", "cut.json", "word.json"]
    assert next(r.document for r in bad.collect() if r.path.endswith("word.json")) == "no json"
    none = files.tolerant_json(spark, f"{tmp_path}/missing.json", "a int")
    assert [x.count() for x in none] == [0, 0]


def test_a_claim_of_a_dead_writer_lapses(spark, tmp_path):
    path, rows = f"{tmp_path}/t", "k long, v string"
    files.keyed_overwrite(spark, path, spark.createDataFrame([(1, "a")], rows), ["k"])
    claim = tmp_path / "t" / "v2.claim"
    claim.touch()
    with pytest.raises(Exception, match="(?i)exist"):
        files.keyed_overwrite(spark, path, spark.createDataFrame([(1, "b")], rows), ["k"])
    os.utime(claim, (1_000_000_000, 1_000_000_000))
    files.keyed_overwrite(spark, path, spark.createDataFrame([(1, "b"), (2, "c")], rows), ["k"])
    assert sorted(map(tuple, files.keyed_table(spark, path).collect())) == [(1, "b"), (2, "c")] and not claim.exists()
    assert not [n for n in os.listdir(tmp_path / "t") if n.startswith("_making")]


def test_a_sink_that_was_stopped_holds_the_rows_of_one_run(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    marker = tmp_path / "stop"
    marker.touch()
    results = stream.withColumn("error", F.when(F.col("id") % 7 == 0, F.lit("seven")))
    step = results.withColumn("id", F.expr(f"if(id = 25 and {str(marker.exists()).lower()}, raise_error('power cut'), id)"))
    folder = f"{tmp_path}/sink"
    with pytest.raises(StreamingQueryException):
        sinks.resumable(step, folder).awaitTermination()
    assert sinks.sunk(spark, folder, ["id"])[2].count() == 20
    sinks.resumable(results, folder).awaitTermination()
    rows, errors, done = sinks.sunk(spark, folder, ["id"])
    assert sorted(r.id for r in rows.collect()) == [i for i in range(40) if i % 7] and sorted(r.id for r in errors.collect()) == list(range(0, 40, 7))
    assert done.count() == 40
    sinks.dropped_from(spark, folder, 2)
    assert sinks.sunk(spark, folder, ["id"])[2].count() == 20


def test_admission_has_rows(spark):
    from weftline import catalog

    assert catalog.queries()["library_admission"](spark, "/root/testdata/sf0.01").count() >= 50
