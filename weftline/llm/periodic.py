"""Periodic runs of words, from branching tandem repeats of a suffix tree (Stoye and Gusfield).

A run is a stretch of words with smallest period q (words q apart are identical), at least MOST_SHORT words and three periods
long, which no neighbouring word extends.

1. *Suffix tree.* The words of some texts are numbered so that no two texts share a number, and their suffixes are sorted by
   doubling. The tree is held as the sorted suffixes (its leaves), the depth of what neighbours share, and the stretch of
   leaves on either side of each such border: a node of several children is a chain of borders of equal depth.
2. *Smaller halves.* At a border of depth p, each leaf of the smaller side looks for the leaves p words on and p words back on
   the other side. One that is there is a branching tandem repeat: two copies of p words, and a word behind that does not go on. A leaf is
   looked at as often as the side that it is on doubles at least, so n leaves take n log n looks.
3. *Rotation and merging.* A branching repeat ends where its run ends. Rotating it to the left, as long as the word before
   equals the one p words on, gives all other repeats of the run, hence its start. Repeats of powers of a shorter period have
   the same end and lie inside its run: they are merged with it.

Texts are looked at whole; those of a batch share a tree of at most about TREE_WORDS words, or of one text, so memory grows with
the longest text alone. A null or empty text has no words and no runs; rows that repeat are looked at one by one; columns besides
doc_id and text are not read; no rows give no rows. Depths beyond a third of a text can hold no run and are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches_of, bounded_batches, text_bytes

MOST_SHORT, PERIODS = 24, 3
TREE_WORDS = 1 << 17
LOOKS = 1 << 20
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_dropped", pa.int64()), ("n_runs", pa.int64())]
    + [(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.binary())]
)
_OUT_DDL = (
    "doc_id long, n_words long, n_dropped long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<array<long>>, collapsed binary"
)
Run = tuple[int, int, int]  # start, length, period


@dataclass(frozen=True)
class SuffixTree:
    """leaves: suffixes in order; place: the inverse. Border k parts leaf k - 1 from leaf k; depth[k] words are common to both."""

    leaves: np.ndarray
    place: np.ndarray
    depth: np.ndarray


def suffix_tree(words: np.ndarray) -> SuffixTree:
    """words: numbers from 0 to less than how many there are."""
    n = len(words)
    leaves = np.argsort(words, kind="stable")
    found = words[leaves]
    joined = np.zeros(n, bool)  # with the leaf before, by all that is known so far
    joined[1:] = found[1:] == found[:-1]
    rank = np.full(n + 1, -1)  # the first place of a suffix's group; behind the end there is nothing
    rank[leaves] = np.maximum.accumulate(np.where(joined, 0, np.arange(n)))
    levels, parted = [rank.astype(np.int32)], np.zeros(n, np.int8)  # the doubling that parted a leaf from the one before
    known = 1
    while len(live := np.flatnonzero(joined | np.append(joined[1:], False))):
        at = leaves[live]
        key = rank[at] * (n + 1) + rank[np.minimum(at + known, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        leaves[live] = at
        borders = live[1:][(key[1:] != key[:-1]) & joined[live[1:]]]
        joined[borders] = False
        parted[borders] = len(levels)
        rank[at] = np.maximum.accumulate(np.where(joined[live], 0, live))
        levels.append(rank.astype(np.int32))
        known *= 2
    depth = np.zeros(n + 1, np.int64)
    for level in range(1, len(levels)):
        at = np.flatnonzero(parted == level)
        a, b = leaves[at - 1], leaves[at]
        common = np.zeros(len(at), np.int64)
        for k in range(level - 1, -1, -1):
            common += np.where(levels[k][np.minimum(a + common, n)] == levels[k][np.minimum(b + common, n)], 1 << k, 0)
        depth[at] = common
    return SuffixTree(leaves, rank[:n], depth)


def _nearest(depth: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each border in at, the nearest one before it (step -1) of less depth, or behind it (step 1) of less or equal depth.

    All borders look at once, and jump over what those in between have jumped over already.
    """
    to = np.arange(len(depth)) + step
    live = np.flatnonzero(depth[:-1])
    while True:
        there = depth[to[live]]
        live = live[there >= depth[live] if step < 0 else there > depth[live]]
        if not len(live):
            return to[at]
        to[live] = to[to[live]]


def branching_repeats(tree: SuffixTree, deepest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats. deepest: for each suffix, the longest period that is asked for."""
    n = len(tree.leaves)
    depth = tree.depth
    at = np.flatnonzero((depth[:n] > 0) & (depth[:n] <= deepest[tree.leaves]))
    first, last = _nearest(depth, at, -1), _nearest(depth, at, 1)
    left = at - first <= last - at  # which side is smaller: leaves first .. at - 1, or at .. last - 1
    begin, size = np.where(left, first, at), np.minimum(at - first, last - at)
    other, end = np.where(left, at, first), np.where(left, last, at)
    starts, periods = [], []
    until = np.cumsum(size)
    cut = 0
    while cut < len(at):
        upto = max(cut + 1, int(np.searchsorted(until, (until[cut - 1] if cut else 0) + LOOKS, "right")))
        part = slice(cut, upto)
        many = size[part]
        node = np.repeat(np.arange(cut, upto), many)
        leaf = tree.leaves[begin[node] + np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)]
        period = depth[at[node]]
        low, high = other[node], end[node]
        for there, start in ((leaf + period, leaf), (leaf - period, leaf - period)):
            inside = (there >= 0) & (there < n)
            where = tree.place[np.where(inside, there, 0)]
            hit = inside & (where >= low) & (where < high)
            starts.append(start[hit])
            periods.append(period[hit])
        cut = upto
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def _rotated(words: np.ndarray, start: int, period: int) -> int:
    """How far a repeat can be rotated to the left."""
    far, step = 0, 64
    while far < start:
        step = min(step, start - far)
        same = words[start - far - step : start - far] == words[start + period - far - step : start + period - far]
        if not same.all():
            return far + step - 1 - int(np.flatnonzero(~same)[-1])
        far, step = far + step, step * 2
    return far


def runs_of(words: np.ndarray, deepest: np.ndarray, shortest: int = MOST_SHORT, periods: int = PERIODS) -> list[Run]:
    """All runs, by start, then period; words of different texts must differ. periods: 2 at least."""
    if not len(words):
        return []
    start, period = branching_repeats(suffix_tree(words), deepest)
    more = np.maximum(shortest, periods * period) - 2 * period  # words that the rotation has to add
    for share in (0, 0.5, 1):  # a look at single words spares most rotations: at the first, the middle and the last of them
        ask = np.clip((more * share).astype(np.int64), 1, None)
        good = start >= ask
        good[good] = words[(start - ask)[good]] == words[(start - ask + period)[good]]
        good |= more <= 0
        start, period, more = start[good], period[good], more[good]
    by = np.lexsort((period, start + 2 * period))
    found: list[Run] = []
    end, least = -1, 0
    for at, p in zip(start[by].tolist(), period[by].tolist(), strict=True):
        if at + 2 * p != end:
            end, least = at + 2 * p, at + 2 * p
        if at >= least:
            continue  # a power of a shorter period, whose run is known
        begin = at - _rotated(words, at, p)
        if end - begin >= max(shortest, periods * p):
            found.append((begin, end - begin, p))
            least = min(least, begin)
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes], first: int = 0) -> np.ndarray:
    """Equal numbers for equal words, from first on."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + first


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end, in about one of ten texts: which, from where and of what period depends on doc_id alone. Without an id they stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _row(doc_id: int | None, words: list[bytes], runs: list[Run], outputs: bool) -> tuple:
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]
    best: list = [None] * 4
    top = None
    for run in runs:  # the first of the greatest exponents stands first by start, then period
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    if top:
        best = [*top, 1000 * top[1] // top[2]]
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    collapsed = b" ".join(kept)
    out = (doc_id, len(words), len(words) - len(kept), len(runs), *best, hashlib.sha256(told).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    return (*out, [list(r) for r in runs], collapsed) if outputs else out


def _searched(rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None, outputs: bool):
    def together(docs: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
        numbers, first = [], 0
        for _, words in docs:
            numbers.append(numbered(words, first))
            first += len(words)
        firsts = np.cumsum([0] + [len(x) for x in numbers])
        deepest = np.repeat([len(x) // PERIODS for x in numbers], [len(x) for x in numbers])
        runs: list[list[Run]] = [[] for _ in docs]
        for start, length, period in runs_of(np.concatenate(numbers), deepest):
            k = int(np.searchsorted(firsts, start, "right")) - 1
            runs[k].append((start - int(firsts[k]), length, period))
        for (doc_id, words), own in zip(docs, runs, strict=True):
            yield _row(doc_id, words, own, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[tuple[int | None, list[bytes]]] = []
            many = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = text.as_py().split()  # of bytes: at 9 to 13 and 32
                    words = rewrite(doc_id, words) if rewrite else words
                    if held and many + len(words) > TREE_WORDS:
                        yield from together(held)
                        held, many = [], 0
                    held.append((doc_id, words))
                    many += len(words)
            if held:
                yield from together(held)

        yield from batches_of(rows(), _OUT if outputs else pa.schema(list(_OUT)[:-2]), 1024)

    return run


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, outputs: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_dropped, n_runs, the run of greatest length by period, digests, runs and the collapsed text.

    runs lists (start, length, period); collapsed leaves out what repeats: each word that a run holds behind its first period.
    rewrite: what becomes of a row's words first. outputs: False leaves out runs and collapsed.
    """
    bounded_batches(docs.sparkSession)
    ddl = _OUT_DDL if outputs else _OUT_DDL.split(", runs array")[0]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_searched(rewrite, outputs), ddl)
    return found.withColumn("collapsed", F.col("collapsed").cast("string")) if outputs else found


def run_digests(docs: DataFrame) -> DataFrame:
    """What find_runs tells of texts of which some were given a periodic end, without the runs and texts themselves."""
    return find_runs(docs, planted, outputs=False)
