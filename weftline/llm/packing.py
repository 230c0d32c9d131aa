"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Texts are tokenised once, into pieces of at most ``capacity`` tokens. What follows needs lengths only, and there are at most
``capacity`` of these, so the packing is planned on the histogram of lengths, whose size is bounded whatever the input:

1. *Martello-Toth reduction* (:func:`reduce_dominated`) fixes sets of at most three pieces that provably dominate every other
   way to fill the sequence holding their largest piece, many equal sets at a time, and takes them out of the instance.
2. *Best fit, decreasing* (:func:`best_fit`) packs what is left; equal pieces go to equal sequences in bulk, with exactly
   the result of placing them one by one.

A plan is a list of (number of sequences, ((length, copies), ...)). Pieces are ranked within their length and find sequence and
offset by rank. Ranks are counted in salted slices of a length; the number of slices of all lengths together is bounded.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Memory, batches_of, bounded_batches, cut, held_for, text_bytes

CAPACITY = 2048
SLICES = 4000
#: Bytes of words and their ids that a worker remembers.
REMEMBERED = 96 << 20
#: Marks behind a word, which are words of their own to the tokenizer.
TRAILING = b",.%&#*"

Plan = list[tuple[int, tuple[tuple[int, int], ...]]]


class WordEncoder:
    """Ids of whole texts under a vocabulary that encodes each white-space separated word on its own.

    That holds for the word-end vocabulary: it drops white space, splits at it, and neither its normaliser nor its merges
    cross it. Texts that may name a special token, or that are split at other than ASCII space, go to the tokenizer as they
    are; so does any word that is not made of plain letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Memory(REMEMBERED)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.tokenize = self.model.tokenize

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _packed(tokens: list) -> bytes:
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # plain ASCII letters are shown as they are
            return self._packed(self.tokenize(word.decode()))
        base = word.rstrip(TRAILING)
        if base != word and base and base[-1:].isalnum():
            return self.word(base) + self.word(word[len(base) :])
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "ɐ" and "İ" not in text:
            shown = text.lower().encode().decode("latin-1").translate(self.shown)
            return self._packed(self.tokenize(shown))
        return self._whole(text)

    def word(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            made = self.known.old.get(word) or self._word(word)
            return self.known.keep(word, made, len(word) + len(made) + 66)
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if b"<|" in text:
            return self._whole(text.decode("utf-8", "replace"))
        words = text.lower().split()
        ids = list(map(self.known.get, words))
        if None in ids:
            ids = [self.word(w) if i is None else i for w, i in zip(words, ids, strict=True)]
        return b"".join(ids)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def encoder(path: str) -> WordEncoder:
    """One for each worker process, which outlives its tasks."""
    held = held_for("packing")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def _pieces_of(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path).encode, int(end).to_bytes(4, "little")

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text) + last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None

        yield from batches_of(rows(), _PIECES)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids: the pieces of each document's ids, ``end`` added.

    A null or empty text is one piece that holds ``end`` alone.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    pieces = rows.mapInArrow(_pieces_of(tokenizer, capacity, end, with_ids), _PIECES_DDL)
    return pieces if with_ids else pieces.drop("ids")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Sets fixed by dominance, and the histogram that is left.

    For a piece of length j and the room beside it, let best be the longest other piece that fits. {j, best} dominates if
    best fills the room, if no two pieces fit, or if best is no shorter than any two that fit and three never do; {j} if none
    fits. {j, best, b} dominates, where best and b are the longest two that fit, if three never fit and no two pieces longer
    than b do. A set stays dominant while pieces of its own lengths go, so it is fixed as often as its lengths last.
    """
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    fixed: Plan = []

    def take(times: int, *lengths: int) -> None:
        fixed.append((times, tuple((n, lengths.count(n)) for n in dict.fromkeys(lengths))))
        for n in lengths:
            left[n] -= times
            if not left[n]:
                del left[n], sizes[bisect_left(sizes, n)]

    def smallest(k: int, without: int, over: int = 0) -> list[int]:
        out: list[int] = []
        for n in sizes[bisect_right(sizes, over) :]:
            out += [n] * min(k - len(out), left[n] - (n == without))
            if len(out) >= k:
                break
        return out

    def times(*lengths: int) -> int:
        return min(left[n] // lengths.count(n) for n in set(lengths))

    def longest(room: int, without: int) -> int:
        at = bisect_right(sizes, room) - 1
        while at >= 0 and sizes[at] == without and left[without] < 2:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def pair(room: int, without: int) -> tuple[int, int]:
        most, found, lo, hi = -1, (0, 0), 0, bisect_right(sizes, room) - 1
        free = lambda n: left[n] - (n == without)
        while lo <= hi:
            a, b = sizes[hi], sizes[lo]
            if not free(a):
                hi -= 1
            elif not free(b):
                lo += 1
            elif a + b > room:
                hi -= 1
            else:
                if a + b > most and (a != b or free(a) >= 2):
                    most, found = a + b, (a, b)
                lo += 1
        return found

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                best = longest(room, j)
                low = smallest(3, j)
                if not best:
                    take(left[j], j) if not low or low[0] > room else None
                elif best == room or len(low) < 2 or low[0] + low[1] > room:
                    take(times(j, best), j, best)
                elif len(low) < 3 or sum(low) > room:
                    a, b = pair(room, j)
                    if best >= a + b:
                        take(times(j, best), j, best)
                    elif a == best and (len(above := smallest(2, j, b)) < 2 or sum(above) > room):
                        take(times(j, a, b), j, a, b)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, decreasing: each piece goes where it leaves least room, or into a new sequence."""
    groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, times: int, content: tuple[tuple[int, int], ...]) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        groups[room].append((times, content))

    def get(room: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        out = groups[room].pop()
        if not groups[room]:
            del groups[room], rooms[bisect_left(rooms, room)]
        return out

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            many, content = get(room) if at < len(rooms) else (-(-n // (capacity // length)), ())
            each = room // length
            full = min(many, n // each)
            if full:
                put(room - each * length, full, (*content, (length, each)))
                n -= full * each
                many -= full
            if n and many and n < each:  # the last of this length
                put(room - n * length, 1, (*content, (length, n)))
                n, many = 0, many - 1
            if many and content:
                put(room, many, content)
    return [(times, content) for held in groups.values() for times, content in held]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(made: Plan) -> np.ndarray:
    """A row for each length in each group of equal sequences, sorted: length, first rank, first sequence, copies, offset."""
    rows, used, sequence = [], {}, 0
    for times, content in made:
        offset = 0
        for length, copies in content:
            first = used.get(length, 0)
            rows.append((length, first, sequence, copies, offset))
            used[length] = first + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, slices: int = SLICES) -> DataFrame:
    """pieces with sequence_id and offset, in place of any columns of these names. Needs a long column length from 1 to capacity; keeps all others.

    Pieces are cut from their lineage first, since they are read three times. No pieces give no rows; pieces that are equal are
    packed each for itself.
    """
    pieces = cut(pieces.drop("sequence_id", "offset"))
    taken = {c.lower() for c in pieces.columns}
    row_, slice_, rank_ = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("row", "slice", "rank"))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    total = sum(counts.values())
    dealt = {n: -(-c * slices // total) for n, c in counts.items()}
    parts = F.element_at(F.create_map(*[F.lit(x) for n in sorted(dealt) for x in (n, dealt[n])]), F.col("length").cast("int")) if dealt else F.lit(1)
    row = F.monotonically_increasing_id()
    sliced = pieces.withColumn(row_, row).withColumn(slice_, F.pmod(F.xxhash64(row_), parts.cast("long")))
    held = {(int(r["length"]), int(r[slice_])): int(r["n"]) for r in sliced.groupBy("length", slice_).agg(F.count("*").alias("n")).collect()}  # at most slices + capacity rows
    keys, befores, before, last = [], [], 0, None
    for length, part in sorted(held):
        before = 0 if length != last else before
        keys.append((length << 32) + part)
        befores.append(before)
        before, last = before + held[length, part], length
    keys, befores, places = np.array(keys, np.int64), np.array(befores, np.int64), _places(plan(counts, capacity))
    edges = (places[:, 0] << 44) + places[:, 1]
    ranked = sliced.withColumn(rank_, F.row_number().over(Window.partitionBy("length", slice_).orderBy(row_)).cast("long")).drop(row_)
    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", slice_, rank_))
            rank = rank - 1 + befores[np.searchsorted(keys, (length << 32) + part)]
            _, first, sequence, copies, offset = places[np.searchsorted(edges, (length << 44) + rank, "right") - 1].T
            at, inside = divmod(rank - first, copies)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence + at, pa.int64()), pa.array(offset + inside * length, pa.int64())], names=[*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, schema)
