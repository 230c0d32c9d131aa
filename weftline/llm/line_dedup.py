"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; a row of a run is (h1, h2, n_docs, max_doc) for
the 128-bit hash of a key, and a run is stored bucketed and sorted by (h1, h2). :class:`LineRuns` takes one batch of documents
after the other: it merge-anti-joins the batch's keys with the runs there are. What is left was never seen before: it is a
run of its own at level 0, so each key is in one run alone. What was seen before goes to a run of repeats, with what it adds to
its key's count. Whenever a level holds ``fanout`` runs, they are merged into one run of the next level, so a key is rewritten a
logarithmic number of times. In the end, counts of keys are formed from their first sightings and, where there are any, the repeats.

Once all batches are in, keys found in ``min_docs`` documents lose all their lines except in the largest doc_id holding them.
Rows that repeat a doc_id count as documents of their own, and as the largest they all keep the line. A null doc_id ranks
below all others. A null or empty text is one empty line.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import batches_of, bounded_batches, checkpoint_dir, cut, in_files, remove, text_bytes

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
_RUN = ["h1", "h2", "n_docs", "max_doc"]
_KEYS = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
_KEPT = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary()), ("sha", pa.string())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None where the key has under min_chars code points."""
    key = line.strip(BLANK)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for h in {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k}:
                        yield doc, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)

        yield from batches_of(rows(), _KEYS, 65536)

    return run


class LineRuns:
    """The levelled runs: tables in the shared folder, bucketed and sorted by key, so that anti joins shuffle nothing."""

    def __init__(self, spark: SparkSession, fanout: int = 3, folder: str | None = None, rows: int | None = None):
        """rows: how many rows there may be of documents and keys; few are kept in few buckets."""
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
        dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.few = rows is not None and rows < 20_000 * dealt
        self.buckets = min(8, dealt) if self.few else dealt
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self._made = 0

    def _stored(self, rows: DataFrame) -> str:
        """rows (_RUN) as a table; its name."""
        self._made += 1
        name = f"{self.folder.rsplit('/', 1)[-1]}_{self._made}".replace("-", "_")
        (rows.coalesce(self.buckets) if self.few else rows).select(*_RUN).write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def _add_run(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            both = self._read(*(f"{self.folder}/{name}" for name in merged))  # no key is in two of them
            self._add_run(self._stored(both if self.few else both.repartition(self.buckets, "h1", "h2")), level + 1)
            for old in merged:
                self._drop(old)

    def _read(self, *paths: str) -> DataFrame:
        """Tables as plain files. Their union as tables would be taken for partitioned by key by Spark 4.1, which it is not."""
        return self.spark.read.schema("h1 long, h2 long, n_docs long, max_doc long").parquet(*paths)

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Those rows of a batch whose keys no run has, by one merge anti join after the other."""
        for run in self._runs():
            batch = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        """Adds a batch, given as (id, h1, h2) with one row for each document and key.

        The keys that the anti joins leave become a run of level 0; those seen before become a run of repeats, of what they add.
        """
        batch = self._stored(keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("max_doc")))
        first = self._stored(self.fresh(self.spark.table(batch)))
        self.repeats.append(f"{self.folder}/repeats-{self._made}")
        seen = self.spark.table(batch).join(self.spark.table(first).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        (seen.coalesce(self.buckets) if self.few else seen).write.parquet(self.repeats[-1])
        self._add_run(first, 0)
        self._drop(batch)

    def totals(self, min_docs: int = 1) -> DataFrame:
        """A row for each key that min_docs documents have: what its first sighting says and what the repeats add; stored beside the runs."""
        out = f"{self.folder}/totals-{uuid.uuid4().hex}"
        if self.repeats:
            added = cut(self._read(*self.repeats).groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("later")), 8 * 20_000 if self.few else None)
            n = F.col("n_docs") + F.coalesce("more", F.lit(0))
            for run in self._runs():
                told = run.join(added, ["h1", "h2"], "left").filter(n >= min_docs)
                told = told.coalesce(self.buckets) if self.few else told
                told.select("h1", "h2", n.alias("n_docs"), F.greatest("max_doc", "later").alias("max_doc")).write.mode("append").parquet(out)
        return self._read(out) if self.repeats else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, max_doc long")

    def close(self) -> None:
        """Drops all that is stored."""
        for name in [name for level in self.levels for name in level]:
            self._drop(name)
        self.levels, self.repeats = [], []
        remove(self.spark, self.folder)


def line_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(id, h1, h2): the distinct keys of min_chars code points at least of each document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("text"))
    return rows.mapInArrow(_keys_of(min_chars), "id long, h1 long, h2 long")


def _without(min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, text, drops in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    lines = text.split(b"\n")
                    gone = set(drops) if drops else ()
                    kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                    out = b"\n".join(kept) if gone else text
                    yield doc, len(lines), len(lines) - len(kept), out if with_text else None, hashlib.sha256(out).hexdigest()

        yield from batches_of(rows(), _KEPT)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, n_batches: int = 4, fanout: int = 3, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, kept_sha256 and, with_text, kept_text.

    The batches are dealt by a hash of the key, document by document; their number changes the work, not the result.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    stored = f"{folder}/keys"
    line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n_batches)).cast("int")).write.partitionBy("batch").parquet(stored)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "h1", "h2")] + [T.StructField("batch", T.IntegerType())])
    keys = spark.read.schema(schema).parquet(stored)
    n_keys = keys.count()
    runs = LineRuns(spark, fanout, folder, n_keys)
    for k in range(n_batches):
        runs.add(keys.filter(F.col("batch") == k))
    repeated = runs.totals(min_docs).select("h1", "h2", "max_doc")
    # Both sides are plain shuffles, so that Spark can split the rows of a line that very many documents hold.
    drops = cut(keys.join(repeated, ["h1", "h2"]).filter("id <> max_doc").select("id", "h1", "h2"), n_keys)
    runs.close()
    drops = drops.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("hs"))
    h16 = F.transform("hs", lambda h: F.concat(_little(h["h1"]), _little(h["h2"])))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("text"))
    kept = (
        rows.join(drops.select("id", h16.alias("drops")), "id", "left")
        .select("id", "text", "drops")
        .mapInArrow(_without(min_chars, with_text), "id long, n_lines long, n_dropped long, kept binary, sha string")
    )
    out = [F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_lines", "n_dropped", F.col("sha").alias("kept_sha256")]
    return kept.select(*out, *[F.decode("kept", "UTF-8").alias("kept_text")] * with_text)


def _little(h):
    """The 8 bytes of a long, smallest first, as xxhash gives them here."""
    hexed = F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)]))


ORACLE_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split
), keyed AS (
  SELECT doc_id, line, i,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.i, r.key IS NOT NULL AND k.doc_id <> r.max_doc AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
