"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer when its smallest inner s-mer, by hash, stands first or last in it. Whether it is one
depends on its own k bytes alone, so equal passages choose equal anchors wherever they stand. A fingerprint holds the
``size`` anchors of smallest hash (all of them, if size is None), each with its first place, as base64 of little-endian unsigned 32-bit
pairs ordered by hash: a bounded sketch of the anchors of the whole text. A text shorter than k bytes is its own single anchor; an empty text has none.

The likeness of two fingerprints is the share of common anchors among the smallest of both together (an estimate of the
Jaccard similarity of all anchors, exact where both hold all of theirs), times the share of the common ones that stand in the same
order in both. With size None it is exact for all texts, and fingerprints grow with them. Two empty fingerprints are alike by 1.
Columns besides doc_id and text are not read; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches_of, bounded_batches, text_bytes

K, S, SIZE = 24, 8, 64
NO_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_anchors", pa.int64())]
)
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long"


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width bytes, by doubling."""
    if width == 1:
        return codes * _M + np.uint64(1)
    half = width // 2
    low = _rolled(codes, half)
    high = low if width == 2 * half else _rolled(codes, width - half)
    n = len(codes) - width + 1
    out = low[:n] * _M
    out += high[half : half + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out


def _smallest_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of width values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of all closed syncmers of a text."""
    if len(text) < k:
        return np.array([xxhash.xxh32_intdigest(text)] * int(bool(text)), np.uint64), np.zeros(int(bool(text)), np.int64)
    codes = np.frombuffer(text, np.uint8).astype(np.uint64)
    inner = _rolled(codes, s)
    least = _smallest_of(inner, k - s + 1)
    n = len(text) - k + 1
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    mixed = inner[at]
    for step in range(s, k - s + 1, s):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _M + inner[at + step]
    if k % s:
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _M + inner[at + k - s]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX
    return mixed >> np.uint64(32), at


def sketch(text: bytes, size: int | None = SIZE, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, int]:
    """The size anchors of smallest hash (ascending, each once, at its first place), and the number of all."""
    hashes, at = anchors(text, k, s)
    if size is not None and len(hashes) > 4 * size:  # the smallest ones, with room for repeats
        few = np.argpartition(hashes, 4 * size)[: 4 * size]
        chosen, first = np.unique(hashes[few], return_index=True)
        if len(chosen) >= size:
            edge = chosen[size - 1]
            few = np.flatnonzero(hashes <= edge)
            chosen, first = np.unique(hashes[few], return_index=True)
            return chosen, at[few][first], len(hashes)
    chosen, first = np.unique(hashes, return_index=True)
    return chosen[:size], at[first][:size], len(hashes)


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    return base64.b64encode(np.column_stack([hashes, at]).astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.int64)


def _in_order(values: list[int]) -> int:
    """Length of the longest rising subsequence."""
    tails: list[int] = []
    for v in values:
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int | None = SIZE) -> float:
    if not len(a[0]) and not len(b[0]):
        return 1.0
    union = np.union1d(a[0], b[0])[:size]
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.searchsorted(common, union[-1], "right"))
    if not shared:
        return 0.0
    place = b[1][j][np.argsort(a[1][i], kind="stable")]
    return shared / len(union) * _in_order(place.tolist()) / len(place)


def _compared(size: int | None):
    def row(doc: int, text: str, mark, following: str, after):
        n, m = len(text), len(text) // 4
        edited = (text[: n - m] + following[:m] if m else text).encode()
        changed = sketch(edited, size)
        return (
            None if doc == NO_ID else doc, n, hashlib.sha256(edited).hexdigest(), written(*mark[:2]), written(*changed[:2]),
            likeness(mark[:2], changed[:2], size), likeness(mark[:2], after[:2], size), mark[2],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held = None  # part, doc, text, sketch of the row that waits for the next
            for batch in batches:
                for part, copy, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    known = text.decode("utf-8", "replace")
                    mark = sketch(text, size)
                    if held and held[0] == part:
                        yield row(*held[1:], known, mark)
                    held = None if copy else (part, doc, known, mark)

        yield from batches_of(rows(), _OUT, 1024)

    return run


def fingerprint_documents(docs: DataFrame, size: int | None = SIZE) -> DataFrame:
    """A row for each row of docs, compared with its edited text and with the next document by ascending doc_id.

    Null ids come first; rows that repeat an id follow each other by a hash of their texts. The last row's next is the first.
    Rows are dealt by ranges of (doc_id, hash), found by sampling, into as many tasks as the session shuffles to; a copy of each range's first
    row goes to the end of the range before it. That only texts once, and no more than one row a range, cross a border.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = rows.select("id", "tie").repartitionByRange(parts, "id", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "tie")).alias("first"))
    firsts = sorted((r["first"]["id"], r["first"]["tie"]) for r in ranges.collect())  # one for each task
    many = len(firsts)

    @F.pandas_udf("array<int>")
    def dealt(ids, ties):
        import pandas as pd

        def of(key):
            at = bisect_right(firsts, key) - 1
            return [at, (at - 1) % many] if firsts[at] == key else [at]

        return pd.Series([of(key) for key in zip(ids.tolist(), ties.tolist(), strict=True)])

    placed = rows.select("id", "tie", "text", F.posexplode(dealt("id", "tie")).alias("copy", "part"))
    together = placed.repartitionById(max(many, 1), "part").sortWithinPartitions("part", "copy", "id", "tie")
    return together.select("part", "copy", "id", "text").mapInArrow(_compared(size), _OUT_DDL)
