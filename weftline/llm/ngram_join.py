"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes of its distinct word shingles. Documents of equal sets are one *node* from the start (its id
is a hash of the set, so copies need not be expanded). Two nodes are linked when 100 * intersection >= percent * union.

1. One pass over the texts gives each document's node and counts shingles in a sketch of fixed size, over all documents. The
   estimated frequency, then the hash, is the order of shingles: rare first. Any order gives the same links; a good one gives
   few candidates.
2. A second pass writes the prefix of each node, as one row: of n shingles, the first n - ceil(percent * n / 100) + 1, which linked
   nodes share at least one of.
3. *Stars.* Prefix shingles are dealt once, by shingle. The first few nodes of a shingle are compared with each other; of all
   others, each with the centres of its size band and the one below, the smallest node there: in a group of near copies that
   links all at once, without its pairs. A shingle that the sketch counts in many documents is salted, and the centres of its
   salts are compared in turn. Pairs pass the length, positional and parity filters, each is verified once, on the whole sets,
   after the suffix filter. Linked nodes form components. The positional filter is that of the first shingle that two sets share:
   what they share is at and behind it, in both. Where they share more, a later one may fail it; the first never does.
4. *Rounds.* Wherever a prefix shingle of more than a few nodes is still shared by different components, each of them is compared
   with the one that most nodes of the shingle are in, by one pair of nodes. That joins most components that belong together, with
   work in proportion to the rows.
5. *Rest.* Where components still differ, all pairs of nodes of different components that share a shingle and were not tried are
   compared, by the same filters. Then no link between different components is left, so components are final.

The parity filter holds a bit or two for each shingle of a set (512 at least), each the parity of the shingles that hash to it: two sets differ in
at least as many shingles as their bits do, so a pair that differs in too many can't be a link, however large its sets are. It
spares the sets of nearly all other pairs.

6. *All links.* Every link lies inside a component, so all pairs of a component's nodes that are in neighbouring size bands are
compared, on the whole sets. Large components are dealt out in pairs of blocks of about BLOCK nodes, so that no task holds one whole
and a set is sent once a block, not once a pair. Components alone (``run``) don't need this step.

Sets are made from the texts again for those nodes that are in a candidate pair; no pass holds the sets of all documents.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Memory, batches_of, bounded_batches, checkpoint_dir, cut, held_for, in_files, remove, text_bytes
from weftline.llm.components import connected

SKETCH_BITS = 20
CHUNKS = 64
#: Nodes of a token in one task, about, before it is salted; nodes of a token that are all compared with each other; partners that a set meets in one task.
HOT, FEW, PARTNERS = 4096, 4, 64
#: How often components are compared, by their ends and then by chance, before what is left of them is compared whole.
ROUNDS = 2
#: Others that a node of a shingle is compared with by chance, about.
CHANCES = 8
#: Nodes of a shingle from which its last comparisons are dealt in blocks.
REST = 4096
#: Bytes of words, and numbers of nodes and pairs, that a worker remembers to spare work; all start anew when full.
WORDS, SEEN = 24 << 20, 100_000
NO_ID = -(1 << 63)
#: Nodes of a block, and the shingles that are compared at a time.
BLOCK, COLUMNS = 256, 4096

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _codes(words: list[bytes]) -> np.ndarray:
    held = held_for("ngram_join")
    known = held.get("words") or held.setdefault("words", Memory(WORDS))
    codes = list(map(known.get, words))
    if None in codes:
        for k, code in enumerate(codes):
            if code is None:
                codes[k] = known.keep(words[k], xxhash.xxh3_64_intdigest(words[k]), len(words[k]) + 80)
    return np.array(codes, np.uint64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of width words; of all its words if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    wide = min(width, len(words))
    codes = _codes(words)
    n = len(codes) - wide + 1
    out = np.zeros(n, np.uint64)
    for k in range(wide):
        out += codes[k : k + n] * np.uint64(_FACTORS[k % len(_FACTORS)] ^ k)
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else NO_ID


def required(n: int, percent: int) -> int:
    """The least intersection that a set of n can have with a linked one."""
    return -(-percent * n // 100)


def overlap_needed(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of a and b: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the intersection of two sorted arrays, from how a middle value splits them."""
    if not len(x) or not len(y):
        return 0
    if not depth:
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    met = at < len(x) and x[at] == y[middle]
    return suffix_bound(x[:at], y[:middle], depth - 1) + met + suffix_bound(x[at + met :], y[middle + 1 :], depth - 1)


def _intersection(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int(np.count_nonzero(x[at] == y)) if len(x) else 0


_COUNTED = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
_COUNTED_DDL = "id long, tie long, node long, n int, chunk int, counts binary"


PARITY = [f"p{k}" for k in range(8)]


def parity(hashes: np.ndarray) -> bytes:
    """For each value of the hashes' last bits, whether it is had an odd number of times; at least as many bits as hashes, a power of two, and 512."""
    bits = max(512, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(x: bytes) -> list[int]:
    """A parity of 512 bits, in PARITY."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, 8)).tolist()


def apart(x: bytes, y: bytes) -> int:
    """How many bits differ, at least as many of which as sets differ in shingles; of two lengths, the longer is folded to the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)

        def rows():
            held, size = [], 0
            for batch in batches:
                for doc, text, tie in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "tie")), strict=True):
                    found = shingles(text, width)
                    held.append(_buckets(found))
                    size += len(found)
                    yield doc, tie, node_of(found), len(found), None, None
                if size > 1 << 19:
                    counts[:] += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                    held, size = [], 0
            if size:
                counts[:] += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
            for k, part in enumerate(counts.reshape(CHUNKS, -1)):
                if part.any():
                    yield None, None, None, None, k, zlib.compress(part.tobytes(), 1)

        yield from batches_of(rows(), _COUNTED, 16384)

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.uint32)
            held[k] = held[k] + part if k in held else part.astype(np.int64)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], names=["chunk", "counts"])


def _gathered(counted: DataFrame) -> np.ndarray:
    """The sketch of all documents: at most CHUNKS rows of fixed size reach the driver."""
    parts = counted.filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(_add_chunks, "chunk int, counts binary")
    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.int64)
    for r in parts.collect():
        out[r["chunk"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(-1)


_PREFIX = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("parity", pa.binary()), *((p, pa.int64()) for p in PARITY)])
_PREFIX_DDL = f"node long, n int, tokens binary, parity binary, {', '.join(p + ' long' for p in PARITY)}"


def _prefixes(width: int, percent: int, frequency):
    """A row for each node of a task: the size of its set, its prefix in order, its parity where that has over 512 bits, and the parity in 512."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequency.value, set()

        def rows():
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found = shingles(text, width)
                    node, n = node_of(found), len(found)
                    if not n or node in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    length = n - required(n, percent) + 1
                    few, rank = found, counts[_buckets(found)]
                    if n > 4 * length:  # only those that may be among the first need to be sorted
                        edge = np.partition(rank, length - 1)[length - 1]
                        chosen = np.flatnonzero(rank <= edge)
                        few, rank = found[chosen], rank[chosen]
                    bits = parity(found)
                    yield node, n, few[np.lexsort((few, rank))[:length]].tobytes(), bits if len(bits) > 64 else None, *folded(bits)

        yield from batches_of(rows(), _PREFIX)

    return run


_DEALT = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("n", pa.int32()), ("node", pa.int64()), ("place", pa.int32())])
_DEALT_DDL = "token long, salt int, n int, node long, place int"


def _deal(frequency, hot: int):
    """A row for each prefix shingle. One that may be in more than hot nodes, by its count, is salted: salt is 0 for all others, and then from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value
        chance = int(counts.mean())  # what other shingles add to a count
        for batch in batches:
            nodes, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            packed = batch.column(2).to_pylist()
            lengths = np.array([len(p) // 8 for p in packed], np.int64)
            tokens, starts = np.frombuffer(b"".join(packed), np.uint64), np.cumsum(lengths) - lengths
            count = counts[_buckets(tokens)] - chance
            salts = np.where(count > max(hot, chance), -(-count // hot), 0)
            node = np.repeat(nodes, lengths)
            salt = np.where(salts > 0, 1 + (node & 0x7FFFFFFF) % np.maximum(salts, 1), 0).astype(np.int32)
            place = (np.arange(len(tokens)) - np.repeat(starts, lengths)).astype(np.int32)
            made = pa.RecordBatch.from_arrays([pa.array(c) for c in (tokens.view(np.int64), salt, np.repeat(sizes, lengths), node, place)], schema=_DEALT)
            for at in range(0, len(tokens), 1 << 16):
                yield made.slice(at, 1 << 16)

    return run


_MET = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("other", pa.int64())])
_MET_DDL = "kind int, token long, node long, n int, place int, other long"
PAIR, SHARED, CENTRE = 0, 1, 2


def _meet(percent: int):
    """From dealt rows, sorted by token, salt, size and node, what the nodes of each token and salt are to each other.

    Each of the first FEW nodes is compared with those before it, each later one with the centres of its size band and of the one
    below: the first node there. PAIR rows (node, other) pass the length and positional filters. Where there are more than FEW
    nodes, or the token is salted, SHARED rows tell all of them, and CENTRE rows the centres of salted ones. No more than the
    centres is held of a token.
    """
    base = np.log(100 / percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, last, few, centres, told = None, None, [], {}, set()
            for batch in batches:
                token, salt, n, node, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
                busy = salt > 0
                busy[[0, -1]] = True  # what is alone here may have company in the batch beside
                beside = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
                busy[1:] |= beside
                busy[:-1] |= beside
                at = np.flatnonzero(busy)
                bands = np.floor(np.log(n[at].astype(float)) / base + 1e-9).astype(int)
                for t, s, size, v, k, band in zip(*(c.tolist() for c in (token[at], salt[at], n[at], node[at], place[at], bands)), strict=True):
                    if (t, s) != key:
                        key, last, few, centres = (t, s), None, [], {}
                    if v == last:
                        continue
                    last, me = v, (size, v, k)
                    for other in few if len(few) < FEW else (centres.get(band), centres.get(band - 1)):
                        if other and 100 * other[0] >= percent * size:
                            ahead = min(other[0] - other[2], size - k)
                            if ahead >= overlap_needed(other[0], size, percent) and (other[1], v) not in told:
                                if len(told) >= SEEN:
                                    told.clear()
                                told.add((other[1], v))
                                yield PAIR, None, other[1], None, None, v
                    fresh = centres.setdefault(band, me) is me
                    if s or len(few) >= FEW:
                        yield CENTRE if s and fresh else SHARED, t, v, size, k, None
                        if not s and len(few) == FEW:
                            yield from ((SHARED, t, x[1], x[0], x[2], None) for x in few)
                    if len(few) <= FEW:
                        few.append(me)

        yield from batches_of(rows(), _MET, 16384)

    return run


_BESIDE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _differ_little(percent: int):
    """From rows (a, b, x, y, n_a, n_b), those pairs (a, b) whose whole parities the filter lets through; where one is null, the short ones have told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, n_a, n_b = (batch.column(c).to_pylist() for c in range(6))
            keep = [x[k] is None or y[k] is None or apart(x[k], y[k]) <= n_a[k] + n_b[k] - 2 * overlap_needed(n_a[k], n_b[k], percent) for k in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_BESIDE).filter(pa.array(keep, pa.bool_()))

    return run


_SETS = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])


def _sets_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((node, shingles(text, width)) for b in batches for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from batches_of(((node, found.tobytes()) for node, found in made if node == node_of(found)), _SETS)

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, whole = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, hashes = (batch.column(c).to_pylist() for c in ("a", "b", "hashes"))
            out = []
            for k in range(len(a)):
                x = np.frombuffer(hashes[k], np.uint64)
                if b[k] is None:
                    lead, whole = a[k], x
                elif lead == a[k]:
                    needed = overlap_needed(len(whole), len(x), percent)
                    if min(len(whole), len(x)) >= needed and suffix_bound(whole, x) >= needed and _intersection(whole, x) >= needed:
                        out.append((a[k], b[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """The intersections of all sets on the left with all on the right, or with each other."""
    sets = left + (right or [])
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = times[at] > 1
    at, rows = (np.cumsum(times > 1) - 1)[at[met]], rows[met]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    out, most = np.zeros((len(left), len(right or left)), np.int64), int((times > 1).sum())
    for low in range(0, most, COLUMNS):
        i, j = np.searchsorted(at, (low, low + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, most - low)), np.float32)
        held[rows[i:j], at[i:j] - low] = 1
        out += (held[: len(left)] @ held[len(left) if right else 0 :].T).astype(np.int64)
    if not right:
        np.fill_diagonal(out, [len(x) for x in left])
    return out


def _all_links(percent: int, listed: bool):
    """From rows (root, x, y, side, node, hashes), sorted: all links (a, b) of the blocks x and y, or how many each node has there."""

    def linked(same: bool, sides: tuple[dict[int, np.ndarray], dict[int, np.ndarray]]) -> pa.RecordBatch | None:
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right:
            return None
        both = _overlaps(list(left.values()), None if same else list(right.values()))
        n = [np.array([len(x) for x in side.values()]) for side in (left, right)]
        hit = 100 * both >= percent * (n[0][:, None] + n[1][None, :] - both)
        i, j = np.nonzero(np.triu(hit, 1) if same else hit)
        if not len(i):
            return None
        a, b = np.array(list(left), np.int64)[i], np.array(list(right), np.int64)[j]
        if listed:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        nodes, times = np.unique(np.concatenate([a, b]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(times.astype(np.int64))], names=["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ({}, {})
        for batch in batches:
            for root, x, y, side, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "side", "node", "hashes")), strict=True):
                if key != (root, x, y):
                    if key and (made := linked(key[1] == key[2], sides)):
                        yield made
                    key, sides = (root, x, y), ({}, {})
                sides[side][node] = np.frombuffer(hashes, np.uint64)
        if key and (made := linked(key[1] == key[2], sides)):
            yield made

    return run


class NgramJoin:
    """The join over one set of documents; its steps keep what the next need in the shared folder."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        bounded_batches(self.spark)
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
        self.folder = f"{checkpoint_dir(self.spark)}/ngrams-{uuid.uuid4().hex}"
        self.sets: list[str] = []

    def _stored(self, df: DataFrame, name: str, rows: int | None = None, each: int = 20_000) -> DataFrame:
        (df if rows is None else in_files(df, rows, each)).write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")

    def run(self, keep_sets: bool = False) -> tuple[DataFrame, DataFrame]:
        """Documents (id, tie, node, n) and components of linked nodes (node, root). The sets are kept for links() or n_links()."""
        counted = self._stored(self.rows.mapInArrow(_count(self.width), _COUNTED_DDL), "counted")
        documents = counted.filter("chunk is null").select("id", "tie", "node", "n")
        needed = F.ceil(self.percent * F.col("n") / 100 - 1e-9)
        self.n_rows, n_tokens = documents.agg(F.count("*"), F.coalesce(F.sum(F.col("n") - needed + 1), F.lit(0))).first()
        frequency = self.spark.sparkContext.broadcast(_gathered(counted))  # of a fixed size
        prefix = self._stored(self.rows.select("text").mapInArrow(_prefixes(self.width, self.percent, frequency), _PREFIX_DDL), "prefix")
        nodes = self._stored(prefix.drop("tokens").dropDuplicates(["node"]), "nodes", self.n_rows)
        met = self._stored(self._met(prefix.select("node", "n", "tokens").mapInArrow(_deal(frequency, HOT), _DEALT_DDL)), "met", n_tokens, 100_000)
        centres = met.filter(f"kind = {CENTRE}").select("token", F.lit(0).alias("salt"), "n", "node", "place")
        found = met.union(self._met(centres)).filter(f"kind = {PAIR}").select(F.col("node").alias("a"), F.col("other").alias("b"))
        tried = self._stored(found.dropDuplicates(["a", "b"]), "tried", self.n_rows)
        shared = met.filter(f"kind <> {PAIR}").select("token", "node", "n", "place")

        links, steps = self._linked(documents, tried, nodes, "star"), 0
        roots = connected(links)
        while steps <= ROUNDS and not (shared := self._split(shared, roots)).isEmpty():
            pairs = self._rest(shared, nodes) if steps == ROUNDS else self._by_chance(shared, steps) if steps else self._ends(shared)
            pairs = self._stored(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{steps}", self.n_rows)
            tried, links = tried.union(pairs), links.union(self._linked(documents, pairs, nodes, f"links{steps}"))
            roots, steps = connected(links), steps + 1
        self._drop("prefix", "nodes", "met", "tried", *[f"pairs{k}" for k in range(steps)], "links", *([] if keep_sets else ["sets"]))
        return documents, roots

    def links(self, documents: DataFrame, roots: DataFrame) -> DataFrame:
        """All links (a, b) between nodes, a < b, each once; after run(keep_sets=True)."""
        sized = self._sized(documents, roots)
        pairs = sized.filter("m = 2").groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
        return self._last(pairs.union(self._dealt(sized).mapInArrow(_all_links(self.percent, True), "a long, b long")), "links")

    def n_links(self, documents: DataFrame, roots: DataFrame) -> DataFrame:
        """(node, n_links) for each node that has links; after run(keep_sets=True). Links are counted where they are found."""
        sized = self._sized(documents, roots)
        pairs = sized.filter("m = 2").select("node", F.lit(1).cast("long").alias("links"))
        counts = pairs.union(self._dealt(sized).mapInArrow(_all_links(self.percent, False), "node long, links long"))
        return self._last(counts.groupBy("node").agg(F.sum("links").alias("n_links")), "n_links")

    def closed(self, result: DataFrame) -> DataFrame:
        """A result, cut from its lineage; all that the join stored goes."""
        out = cut(result, self.n_rows)
        remove(self.spark, self.folder)
        return out

    def _last(self, df: DataFrame, name: str) -> DataFrame:
        stored = self._stored(df, name, self.n_rows)
        self._drop("sets")
        return stored

    def _sized(self, documents: DataFrame, roots: DataFrame) -> DataFrame:
        """Linked nodes with their band and the number of nodes of their component; cut, as it is read more than once."""
        nodes = documents.join(roots.select("node"), "node", "left_semi").select("node", "n").distinct()
        placed = roots.join(nodes, "node").withColumn("band", self._band(F.col("n"))).select("node", "root", "band")
        return cut(placed.join(placed.groupBy("root").agg(F.count("*").alias("m")), "root"), self.n_rows)

    def _dealt(self, sized: DataFrame) -> DataFrame:
        """The sets of components of three nodes and more, to each pair of blocks that they are in. Two nodes have one link."""
        bands = sized.filter(F.col("m") > BLOCK).groupBy("root", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
        beside = [bands.select("root", (F.col("band") + d).alias("band"), F.col("k").alias(name)) for d, name in ((-1, "up"), (1, "down"))]
        blocks = bands
        for other in beside:
            blocks = blocks.join(other, ["root", "band"], "left")
        blocks = blocks.na.fill(0, ["up", "down"])
        many = sized.filter(F.col("m") > BLOCK).join(blocks, ["root", "band"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        upto = "if({0} > 0, sequence(0, {0} - 1), cast(array() as array<int>))".format
        code = "(cast({} as long) * 16777216 + {} + 1)".format
        ways = ", ".join(
            f"transform({upto(of)}, j -> named_struct('x', {x}, 'y', {y}, 'side', {side}))"
            for of, x, y, side in (
                ("k", code("band", "least(i, j)"), code("band", "greatest(i, j)"), "if(i <= j, 0, 1)"),
                ("up", code("band", "i"), code("band + 1", "j"), "0"),
                ("down", code("band - 1", "j"), code("band", "i"), "1"),
            )
        )
        few = sized.filter(f"m > 2 and m <= {BLOCK}").selectExpr("node", "root", "0L as x", "0L as y", "0 as side")
        ways = few.union(many.selectExpr("node", "root", f"explode(concat({ways})) as w").selectExpr("node", "root", "w.x", "w.y", "w.side"))
        sets = self.spark.read.schema("node long, hashes binary").parquet(*self.sets)
        met = ways.join(sets, "node").select("root", "x", "y", "side", "node", "hashes")
        return met.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "side", "node")

    def _band(self, n):
        """Sizes in one band are within the length filter of each other."""
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / self.percent)) + 1e-9).cast("int")

    def _passes(self, a: str, b: str):
        """The length filter, and the positional one."""
        n_a, n_b, at_a, at_b = (F.col(f"{s}.{c}") for c in ("n", "place") for s in (a, b))
        needed = F.ceil(self.percent * (n_a + n_b) / (100 + self.percent) - 1e-9)
        return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * self.percent) & (F.least(n_a - at_a, n_b - at_b) >= needed)

    def _met(self, dealt: DataFrame) -> DataFrame:
        order = ["token", "salt", "n", "node"]
        return dealt.repartition("token", "salt").sortWithinPartitions(*order).select(*order, "place").mapInArrow(_meet(self.percent), _MET_DDL)

    def _few_apart(self, a: str, b: str):
        """The parity filter, on 512 bits."""
        n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
        most = n_a + n_b - 2 * F.ceil(self.percent * (n_a + n_b) / (100 + self.percent) - 1e-9)
        return sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY), F.lit(0)) <= most

    def _may_link(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Those pairs that the parity filter lets through."""
        left, right = (nodes.select(F.col("node").alias(c), F.struct("n", "parity", *PARITY).alias(s)) for c, s in ("ax", "by"))
        both = pairs.join(left, "a").join(right, "b").filter(self._few_apart("x", "y"))
        ends = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("parity", "n") for s in "xy"]
        return both.select("a", "b", *ends).mapInArrow(_differ_little(self.percent), "a long, b long")

    def _linked(self, documents: DataFrame, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Those pairs that are links, stored."""
        likely = self._stored(self._may_link(pairs, nodes), f"likely/{name}", self.n_rows)
        links = self._stored(self._verify(documents, likely), f"links/{name}", self.n_rows)
        self._drop(f"likely/{name}")
        return links

    def _split(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of shingles that different components share, with root, main (the component that most nodes of the shingle are in) and size (how many nodes these are)."""
        rooted = shared.select("token", "node", "n", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        told = rooted.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "root")).alias("c"), F.count("*").alias("roots"), F.sum("m").alias("size"))
        split = told.filter("roots > 1").select("token", F.col("c.root").alias("main"), "size")
        return cut(rooted.join(split, "token"), self.n_rows)

    def _ends(self, split: DataFrame) -> DataFrame:
        """Pairs (a, b) for each shingle, one for each component: where it has the shingle first, with where the main component has it first."""
        ends = split.groupBy("token", "root", "main").agg(F.min(F.struct("place", "n", "node")).alias("e")).select("token", "root", "main", "e.*")
        x, y = ends.filter("root <> main").alias("x"), ends.filter("root = main").alias("y")
        return self._ordered(x.join(y, F.col("x.token") == F.col("y.token")).filter(self._passes("x", "y")))

    def _by_chance(self, split: DataFrame, seed: int) -> DataFrame:
        """Pairs (a, b) of nodes in different components that fall together: each node of a shingle asks at one of its places, and waits at another; a place has about CHANCES of each.

        That is so many pairs a row, whatever the size of a shingle; components with many links between them are all but sure to meet in one.
        """
        place = lambda k: F.pmod(F.xxhash64(F.lit(2 * seed + k), "token", "node"), F.ceil(F.col("size") / CHANCES)).alias("at")
        x, y = (split.select("token", "node", "n", "place", "root", place(k)).alias(s) for k, s in enumerate("xy"))
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.root") != F.col("y.root"))
        return self._ordered(x.join(y, same & self._passes("x", "y")))

    def _rest(self, split: DataFrame, nodes: DataFrame) -> DataFrame:
        """All pairs (a, b) of nodes in different components that share a shingle and pass the filters.

        A shingle of more than REST nodes is dealt in blocks, and each pair of blocks meets by itself: no task gets more than two blocks of a shingle.
        """
        told = cut(split.join(nodes.select("node", *PARITY), "node"), self.n_rows)
        large = told.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") > REST).select("token", F.ceil(F.col("m") / REST).cast("int").alias("k"))
        dealt = told.join(large, "token", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        met = [dealt.withColumnRenamed("own", mine).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("k") - 1))) for mine, theirs in (("i", "j"), ("j", "i"))]
        odd, all_ = met[0].filter("root <> main").alias("x"), met[1].alias("y")
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        return self._ordered(odd.join(all_, same & (F.col("x.root") != F.col("y.root")) & self._passes("x", "y") & self._few_apart("x", "y")))

    def _ordered(self, pairs: DataFrame) -> DataFrame:
        """Each pair of nodes x and y once, the smaller one as a."""
        first = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
        ends = (F.when(first, F.col(f"{p}.node")).otherwise(F.col(f"{q}.node")) for p, q in ("xy", "yx"))
        return pairs.select(*[e.alias(c) for e, c in zip(ends, "ab", strict=True)]).dropDuplicates(["a", "b"])

    def _sets(self, documents: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, hashes) for nodes, each from one document that has it."""
        one = documents.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "tie")).alias("one")).select("node", "one.*")
        texts = self._some_rows(one).join(one, ["id", "tie"]).select("node", "text")
        return texts.mapInArrow(_sets_of(self.width), "node long, hashes binary")

    def _some_rows(self, wanted: DataFrame) -> DataFrame:
        """Those rows that may be wanted, by a filter of fixed size, so that not all texts are shuffled for the join that follows."""
        bits = 1 << 23

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            field = np.zeros(bits // 8, np.uint8)
            for b in batches:
                at = b.column(0).to_numpy(zero_copy_only=False)
                np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
            if field.any():
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(field.tobytes(), 1)], pa.binary())], names=["field"])

        slot = F.pmod(F.xxhash64("id", "tie"), F.lit(bits)).cast("int")
        fields = wanted.select(slot.alias("slot")).distinct().coalesce(16).mapInArrow(mark, "field binary").collect()  # at most 16 of 1 MB
        field = np.zeros(bits // 8, np.uint8)
        for r in fields:
            field |= np.frombuffer(zlib.decompress(r["field"]), np.uint8)
        shipped = self.spark.sparkContext.broadcast(field)

        @F.arrow_udf("boolean")
        def maybe(slots: pa.Array) -> pa.Array:
            at = slots.to_numpy(zero_copy_only=False)
            return pa.array((shipped.value[at >> 3] >> (at & 7)) & 1 == 1)

        return self.rows.filter(maybe(slot))

    def _verify(self, documents: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that are links. The set of a goes once to about PARTNERS of its partners; their sets stream past it."""
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
        salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        name = f"sets/{uuid.uuid4().hex[:8]}"
        sets = self._stored(self._sets(documents, nodes), name, self.n_rows, 2_000)
        self.sets.append(f"{self.folder}/{name}")
        leads = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes")
        members = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "hashes")
        dealt = leads.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return dealt.select("a", "b", "hashes").mapInArrow(_verified(self.percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included),
    class_id (equal for equal sets, and for these only) and n_links, the number of other classes that its class is linked with.

    Texts without words, empty and null ones have no shingles and are linked with nothing, not even with each other. A null
    doc_id ranks above all others as a component's name, so a component has one only if all its ids are null. Repeated rows
    are documents of their own. The input must give the same rows each time it is read: a stored table, or a checkpoint.
    """
    join = NgramJoin(docs, width, percent)
    documents, roots = join.run(keep_sets=True)
    n_links = join.n_links(documents, roots)
    grown = documents.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    named = grown.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = named.select("node", "root").join(component, "root").select("node", "component_id")
    told = grown.join(nodes, "node", "left").join(n_links, "node", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("node")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    return join.closed(told)


def near_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): all links between classes (class_id of near_duplicates), a < b, each once."""
    join = NgramJoin(docs, width, percent)
    return join.links(*join.run(keep_sets=True))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, and all that are linked with nothing.

    Of rows that repeat a doc_id with the same text, one stays if it is the component's.
    """
    join = NgramJoin(docs, width, percent)
    documents, roots = join.run()
    mine = documents.filter("n > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = mine.groupBy("root").agg(F.min(F.struct(F.expr(f"id = {NO_ID}").alias("last"), "id", "tie")).alias("first")).select("first.id", "first.tie")
    kept = join.closed(first.union(documents.filter("n = 0").select("id", "tie").distinct()))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_bytes()).alias("tie"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    )
    stay = rows.join(kept, ["id", "tie"], "left_semi")
    return stay.select("row.*")


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), members AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM members x JOIN members y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n_both >= 85 * (len(x.s) + len(y.s) - n_both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
)
SELECT s.doc_id, cast(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""
