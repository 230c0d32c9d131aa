"""Exact deduplication by skew-safe combining.

Equal texts are found in three stages, and each of them compares whole texts, never digests alone:

1. *Locally*: within an Arrow batch, equal texts are merged. One row a text and batch carries the text on.
2. *Salted*: those rows meet by (digest, salt), so that a digest held by a third of all rows is dealt over ``salts`` tasks: as
   many as the session shuffles to, and 16 at least.
3. *Globally*: the winners of the salts, at most ``salts`` rows a text, meet by digest alone.

Members never travel with their text: they find their group through the row that stood for them (local, then salted),
and each of these has a bounded number of members.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
doc_id stays. A null doc_id ranks below all others. Of rows that repeat a doc_id and a text, the last read stays.
The input must be a stored table (or a checkpoint): rows are told apart by their place in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import batches_of, bounded_batches, lower_ascii, text_bytes

NO_ID = -(1 << 63)

_LOCAL = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("digest", pa.binary()), ("local_uid", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])
_LOCAL_DDL = "uid long, id long, digest binary, local_uid long, n long, content binary"


def _combine_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uids, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        contents = [t.lower() for t in texts]  # bytes: A-Z only
        winner: dict[bytes, int] = {}  # a dict of bytes compares whole contents
        count: dict[bytes, int] = {}
        for k, content in enumerate(contents):
            count[content] = count.get(content, 0) + 1
            best = winner.get(content)
            if best is None or (ids[k], uids[k]) > (ids[best], uids[best]):
                winner[content] = k
        rows = ((uids[k], ids[k], hashlib.sha256(c).digest(), uids[w := winner[c]], count[c] if w == k else 0, c if w == k else None) for k, c in enumerate(contents))
        yield from batches_of(rows, _LOCAL)


def _local(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("text")
    )
    return rows.mapInArrow(_combine_locally, _LOCAL_DDL)


def _combine(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds best (id and uid of the row that stays) and total to rows, for rows equal in keys and content."""
    group = Window.partitionBy(*keys, "content")
    return rows.withColumns({"best": F.max(F.struct("id", "uid")).over(group), "total": F.sum("n").over(group)})


def _salt(spark: SparkSession, salts: int | None) -> Column:
    return F.pmod(F.xxhash64("uid"), F.lit(salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def exact_duplicates(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Empty and null texts form one group. No rows give no rows. Columns other than doc_id and text are not read.
    """
    local = _local(docs)
    salted = (
        local.filter(F.col("content").isNotNull())
        .withColumn("salt", _salt(docs.sparkSession, salts))
        .repartition("digest", "salt")
    )
    salted = _combine(salted, "digest", "salt").select("uid", "id", "digest", "content", F.col("best.uid").alias("salt_uid"), "total")
    winners = salted.filter("uid = salt_uid").select("uid", "id", "digest", "content", F.col("total").alias("n")).repartition("digest")
    kept = _combine(winners, "digest").select(
        F.col("uid").alias("salt_uid"), F.col("n").alias("total"), F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("total").alias("group_size")
    )
    # Joined on total, too, so that both sides read the same columns of the salted stage: then Spark shuffles its texts once.
    places = salted.select(F.col("uid").alias("local_uid"), "salt_uid", "total").join(kept, ["salt_uid", "total"]).drop("salt_uid", "total")

    def known(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c))

    return (
        local.select("uid", "id", "digest", "local_uid")
        .join(places, "local_uid")
        .select(
            known("id").alias("doc_id"),
            known("keep_id").alias("keep_id"),
            "group_size",
            (F.col("uid") == F.col("keep_uid")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def _winners_of():
    """From (uid, id, text, row): id, digest and row of the row that stands for each text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            winner: dict[bytes, int] = {}
            for k, text in enumerate(texts):
                content = text.lower()  # bytes: A-Z only
                best = winner.get(content)
                if best is None or (ids[k], uids[k]) > (ids[best], uids[best]):
                    winner[content] = k
            at = pa.array(list(winner.values()), pa.int64())
            digests = pa.array([hashlib.sha256(c).digest() for c in winner], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("uid", "id")), digests, batch.column("row").take(at)], names=["uid", "id", "digest", "row"])

    return run


def without_duplicates(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns (whatever their names).

    The rows that stand for their texts are carried whole from stage to stage, and so shuffled twice; whole contents are compared
    at each, in the row's own text.
    """
    bounded_batches(docs.sparkSession)
    carried = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        text_bytes().alias("text"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("digest", T.BinaryType()), carried.schema["row"]])
    local = carried.mapInArrow(_winners_of(), out).withColumn("salt", _salt(docs.sparkSession, salts))

    def combined(rows: DataFrame, *keys: str) -> DataFrame:
        content = lower_ascii(F.coalesce(F.col("row.text"), F.lit("")))
        best = F.max(F.struct("id", "uid")).over(Window.partitionBy(*keys, "content"))
        return rows.repartition(*keys).withColumn("content", content).withColumn("best", best).filter("uid = best.uid").drop("content", "best")

    return combined(combined(local, "digest", "salt"), "digest").select("row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
