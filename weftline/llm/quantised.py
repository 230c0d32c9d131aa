"""Near duplicates of vectors by product quantisation: inverted lists, table-lookup distances, exact cosine.

Vectors of equal label and length link when their cosine is at least LEAST. Of unit vectors that is a distance of at most
r = sqrt(2 - 2 LEAST), and every step leaves out only what that rules out, so that all links are found, and none is made without
its exact cosine in double precision.

1. *Nodes.* Equal vectors of a label are one node with a weight, so copies need not be expanded.
2. *Fit.* Centres of coarse lists, and the codewords of residuals in subspaces, come from at most FIT_VALUES / length vectors of
   smallest hash. That bounds the books, which travel to all tasks; they decide how fast the search is, not what it finds.
   There are as many centres as keep a label's lists at about LIST rows, up to MOST_LISTS.
3. *Lists and probes.* Every vector is put in the list of its nearest centre a, as codewords of its residual, with the
   error that these leave. It looks into each list b behind its own that can hold a vector within r: its distance to the plane half way between a
   and b is at most r. These probes suffice; a pair in two lists is met once, from the former one.
4. *Table lookups.* A probing vector holds a table of its products with all codewords; the sum of those that a row's codes name tells the
   distance to what the codes stand for. Where that exceeds r by more than the row's error, the row is left out.
5. *Rerank.* The cosine of what is left is computed in full. Links are counted where they are found, not listed: a task hands on
   each vector's number of links and one of its neighbours, which is enough for components.

A list of many rows is dealt in blocks of BLOCK, and what looks into it in chunks of CHUNK; a task holds one block and streams the
chunk through it, so a label or a group of near copies that holds a third of all rows is many tasks. Vectors of a length that the
sample lacks form one list each label, without codes.

Null, empty and zero vectors, vectors with null or non-finite components, and those of null label link with nothing. A null id is
never the smallest; a component of rows without ids has none. Rows that repeat an id are vectors of their own. No rows give no rows;
columns besides these three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches_of, bounded_batches, cut
from weftline.llm.components import connected

LEAST = 0.98
FIT_VALUES = 1 << 20
LIST, MOST_LISTS = 512, 1024
PART, CODEWORDS = 8, 256
BLOCK, CHUNK = 8192, 32768
_TOGETHER = 128
_SLACK = 1e-5  # of table lookups in single precision
_ROUNDS = 8


@dataclass(frozen=True)
class Book:
    """Of one number of lists. gaps: distances between centres; codewords: of each part of the residual; edges: where parts begin and end."""

    centres: np.ndarray
    gaps: np.ndarray
    codewords: list[np.ndarray]
    edges: list[int]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centres, without the rows' own norms, and the nearest one."""
    far = (centres**2).sum(1) - 2 * (rows @ centres.T)
    return far, far.argmin(1)


def _centres(rows: np.ndarray, many: int) -> np.ndarray:
    """Lloyd's iterations from rows that are taken in equal steps."""
    many = min(many, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, many).astype(int)].copy()
    for _ in range(_ROUNDS):
        _, own = _nearest(rows, centres)
        size = np.bincount(own, minlength=many)
        sums = np.stack([np.bincount(own, weights=c, minlength=many) for c in rows.T], 1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def fit_book(rows: np.ndarray, lists: int) -> Book:
    """rows: unit vectors; none, for a book of one list at 0 without codes."""
    dim = rows.shape[1]
    if not len(rows):
        return Book(np.zeros((1, dim)), np.zeros((1, 1)), [], [0])
    centres = _centres(rows, lists)
    left = rows - centres[_nearest(rows, centres)[1]]
    parts = max(1, round(dim / PART))
    edges = [round(k * dim / parts) for k in range(parts + 1)]
    codewords = [_centres(left[:, a:b], CODEWORDS) for a, b in zip(edges, edges[1:])]
    gaps = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2) if len(centres) <= 64 else _squared_gaps(centres), 0))
    return Book(centres, gaps, codewords, edges)


def _squared_gaps(centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(1)
    return norms[:, None] + norms[None, :] - 2 * centres @ centres.T


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # else squares may overflow or vanish
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def coded(rows: np.ndarray, book: Book, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """List, codes and least lookup of each row, and the lists behind its own that may hold rows within the radius.

    A vector within the radius of a row has a product with what the row's codes stand for that is at least the least lookup.
    """
    far, own = _nearest(rows, book.centres)
    edge = far - far[np.arange(len(rows)), own][:, None] <= 2 * radius * book.gaps[own] + 1e-9
    edge &= np.arange(len(book.centres))[None, :] > own[:, None]
    stands = book.centres[own].copy()
    left = rows - stands
    codes = np.zeros((len(rows), len(book.codewords)), np.uint8)
    for k, words in enumerate(book.codewords):
        part = slice(book.edges[k], book.edges[k + 1])
        codes[:, k] = _nearest(left[:, part], words)[1]
        stands[:, part] += words[codes[:, k]]
    error = np.sqrt(((rows - stands) ** 2).sum(1))
    least = (1 + (stands**2).sum(1) - (radius + error) ** 2) / 2 - _SLACK
    return own, codes, least, [np.flatnonzero(e) for e in edge]


class Block:
    """A block of a list, which chunks of vectors are compared with."""

    def __init__(self, book: Book, at: int, least_cosine: float, nodes: np.ndarray, weights: np.ndarray, codes: np.ndarray, least: np.ndarray, rows: np.ndarray):
        self.book, self.centre, self.least_cosine = book, book.centres[at], least_cosine
        self.nodes, self.weights, self.codes, self.least, self.rows = nodes, weights, codes, least, rows
        self.links = np.zeros(len(nodes), np.int64)
        self.root = np.arange(len(nodes))

    def _lookups(self, rows: np.ndarray) -> np.ndarray:
        out = np.repeat((rows @ self.centre).astype(np.float32)[:, None], len(self.nodes), 1)
        for k, words in enumerate(self.book.codewords):
            table = (rows[:, self.book.edges[k] : self.book.edges[k + 1]] @ words.T).astype(np.float32)
            out += np.take(table, self.codes[:, k], axis=1)
        return out

    def compared(self, nodes: np.ndarray, weights: np.ndarray, rows: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(node, links, a neighbour) of the vectors that link. own: whether a vector is of this list itself; such a pair is met by its later node."""
        near = self._lookups(rows) >= self.least[None, :]
        near &= ~own[:, None] | (self.nodes[None, :] < nodes[:, None])
        if np.count_nonzero(near) * 16 > near.size:
            of, to = np.nonzero(near & (rows @ self.rows.T >= self.least_cosine))
        else:
            of, to = np.nonzero(near)
            linked = np.einsum("ij,ij->i", rows[of], self.rows[to]) >= self.least_cosine
            of, to = of[linked], to[linked]
        if not len(of):
            return
        links = np.bincount(of, weights=self.weights[to], minlength=len(nodes)).astype(np.int64)
        self.links += np.bincount(to, weights=weights[of], minlength=len(self.nodes)).astype(np.int64)
        there, first = np.unique(of, return_index=True)
        neighbour = np.zeros(len(nodes), np.int64)
        neighbour[there] = to[first]
        self._join(neighbour[of], to)
        yield from zip(nodes[there].tolist(), links[there].tolist(), self.nodes[neighbour[there]].tolist(), strict=True)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        low, high = self.root[a], self.root[b]
        apart = low != high
        root = self.root.tolist()

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        pairs = np.unique(np.stack([low[apart], high[apart]]), axis=1) if apart.any() else np.zeros((2, 0), int)
        for x, y in zip(*pairs.tolist(), strict=True):
            x, y = sorted((top(x), top(y)))
            root[y] = x
        self.root = np.array(root)
        while not np.array_equal(self.root[self.root], self.root):
            self.root = self.root[self.root]

    def ended(self) -> Iterator[tuple[int, int, int]]:
        at = np.flatnonzero(self.links)
        yield from zip(self.nodes[at].tolist(), self.links[at].tolist(), self.nodes[self.root[at]].tolist(), strict=True)


Books = dict[tuple[int, int], Book]


def _book(books: Books, dim: int, level: int) -> Book:
    while level and (dim, level) not in books:
        level -= 1
    return books.get((dim, level)) or fit_book(np.zeros((0, dim)), 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_CODED = pa.schema(
    [("node", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("level", pa.int32()), ("weight", pa.int64()), ("list", pa.int32())]
    + [("codes", pa.binary()), ("least", pa.float64()), ("probes", pa.list_(pa.int32())), ("vec", pa.list_(pa.float64()))]
)
_CODED_DDL = "node long, label string, dim int, level int, weight long, list int, codes binary, least double, probes array<int>, vec array<double>"


def _coding(books: Books, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table["dim"].to_pylist(), table["level"].to_pylist(), strict=True))
            for dim, level in sorted(set(keys)):
                part = table.take([k for k, key in enumerate(keys) if key == (dim, level)]).combine_chunks()
                rows = unit(_matrix(part["vec"].chunk(0)))
                own, codes, least, probes = coded(rows, _book(books, dim, level), radius)
                columns = [part[c].combine_chunks() for c in ("node", "label", "dim", "level", "weight")]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                flat = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * dim, rows.ravel())
                columns += [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(least), pa.array(probes, pa.list_(pa.int32())), flat]
                yield pa.RecordBatch.from_arrays(columns, schema=_CODED)

    return run


_TOLD = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("peer", pa.int64())])
_KEY = ["label", "dim", "level", "list", "block", "chunk"]


def _comparing(books: Books, least_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, held, block = None, [], None
            for batch in batches:
                names = batch.schema.names
                keys = list(zip(*(batch.column(names.index(c)).to_pylist() for c in [*_KEY, "role"]), strict=True))
                starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
                for begin, end in zip(starts, [*starts[1:], len(keys)]):
                    part = batch.slice(begin, end - begin)
                    column = lambda c, part=part, names=names: part.column(names.index(c))
                    if keys[begin][:-1] != key:
                        if block:
                            yield from block.ended()
                        key, held, block = keys[begin][:-1], [], None
                    nodes, weights, vecs = column("node").to_numpy(), column("weight").to_numpy(), _matrix(column("vec"))
                    if not keys[begin][-1]:
                        codes = np.frombuffer(b"".join(column("codes").to_pylist()), np.uint8).reshape(len(nodes), -1)
                        held.append((nodes, weights, codes, column("least").to_numpy(), vecs))
                        continue
                    if block is None:
                        if not held:
                            continue  # a list without rows
                        block = Block(_book(books, key[1], key[2]), key[3], least_cosine, *map(np.concatenate, zip(*held, strict=True)))
                        held = []
                    own = column("own").to_numpy(zero_copy_only=False)
                    for k in range(0, len(nodes), _TOGETHER):
                        few = slice(k, k + _TOGETHER)
                        yield from block.compared(nodes[few], weights[few], vecs[few], own[few])
            if block:
                yield from block.ended()

        yield from batches_of(rows(), _TOLD, 10_000)

    return run


def _usable(vec: Column) -> Column:
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def _fitted(nodes: DataFrame, dim: int, top: int) -> Books:
    """Books by (length, level) from the vectors of smallest hash. nodes: a stored table; dim: its greatest length."""
    few = nodes.orderBy(F.xxhash64("vec"), "node").select("dim", "vec").limit(max(CODEWORDS, FIT_VALUES // dim)).toArrow()
    books: Books = {}
    dims = np.array(few["dim"].to_pylist())
    for own in sorted(set(dims.tolist())):
        rows = unit(np.array(few["vec"].take(np.flatnonzero(dims == own)).to_pylist(), np.float64))
        for level in range(top + 1):
            if level and (1 << level) * 8 > len(rows):
                break
            books[own, level] = fit_book(rows, 1 << level)
    return books


def near_vectors(vectors: DataFrame, least_cosine: float = LEAST, list_rows: int = LIST, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept, n_copies for each row of vectors (vec_id, embedding, label). n_copies: rows of the same label and components, itself included."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least_cosine))) + 1e-7
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # -0 to 0
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), vec.alias("vec"))
    good = F.col("label").isNotNull() & _usable(F.col("vec"))
    groups = rows.filter(good).groupBy("label", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    nodes = cut(groups.select(F.monotonically_increasing_id().alias("node"), "label", "vec", "least_id", "weight", F.size("vec").alias("dim")))

    labels = nodes.groupBy("label", "dim").agg(F.count("*").alias("many"))
    level = F.least(F.floor(F.log2(F.col("many") / list_rows)), F.lit(int(np.log2(MOST_LISTS)))).cast("int")
    large = labels.filter(F.col("many") >= 2 * list_rows).select("label", "dim", level.alias("level"))
    told = labels.agg(F.max("dim").alias("dim"), F.max("many").alias("many")).first()
    top = int(min(np.log2(MOST_LISTS), max(0, np.log2(max(told["many"] or 1, 1) / list_rows))))
    books = _fitted(nodes, told["dim"], top) if told["dim"] else {}
    known = nodes.join(large, ["label", "dim"], "left").select("node", "label", "dim", F.coalesce("level", F.lit(0)).alias("level"), "weight", "vec")
    index = cut(known.mapInArrow(_coding(books, radius), _CODED_DDL))

    held = index.groupBy("label", "dim", "list").agg(F.count("*").alias("rows"))
    asks = index.select("label", "dim", F.explode("probes").alias("list")).groupBy("label", "dim", "list").agg(F.count("*").alias("asks"))
    dealt = held.join(asks, ["label", "dim", "list"], "left").select(
        "label", "dim", "list", F.ceil(F.col("rows") / block).cast("int").alias("blocks"), F.ceil((F.col("rows") + F.coalesce("asks", F.lit(0))) / chunk).cast("int").alias("chunks")
    )
    dealt = dealt.filter("blocks > 1 OR chunks > 1")

    def dealing(df: DataFrame, mine: str, many: str, other: str, others: str) -> DataFrame:
        """Each row goes to one of its own parts, and to all parts of the other kind."""
        many, others = (F.coalesce(c, F.lit(1)) for c in (many, others))
        salted = df.join(dealt, ["label", "dim", "list"], "left").withColumn(mine, F.pmod(F.xxhash64("node"), many).cast("int"))
        return salted.withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))

    columns = [*_KEY, "role", "node", "weight", "own", "codes", "least", "vec"]
    blocks = dealing(index.drop("probes"), "block", "blocks", "chunk", "chunks").select("*", F.lit(0).alias("role"), F.lit(True).alias("own"))
    asked = index.select("node", "label", "dim", "level", "weight", "vec", F.posexplode(F.concat(F.array("list"), "probes")).alias("at", "list"))
    asked = dealing(asked, "chunk", "chunks", "block", "blocks").select(
        "*", F.lit(1).alias("role"), (F.col("at") == 0).alias("own"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("least")
    )
    tiles = blocks.select(columns).unionByName(asked.select(columns)).repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "role")
    found = cut(tiles.mapInArrow(_comparing(books, least_cosine), "node long, links long, peer long"))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.filter("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    least = roots.join(nodes.select("node", "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("component_id"))
    places = roots.join(least, "root").select("node", "component_id")
    mark = [F.xxhash64("label", "vec").alias("m1"), F.xxhash64(F.lit(1), "vec", "label").alias("m2")]
    of_nodes = nodes.join(counts, "node", "left").join(places, "node", "left").select(
        *mark, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"), F.col("weight").alias("n_copies")
    )
    marked = rows.select("vec_id", *(F.when(good, m).alias(n) for m, n in zip(mark, ("m1", "m2"))))
    out = marked.join(of_nodes, ["m1", "m2"], "left")
    alone = F.col("n_copies").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").cast("long").eqNullSafe(component).alias("kept"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


ORACLE_SQL = f"""
WITH RECURSIVE told AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v FROM embeddings),
vecs AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM told
         WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {LEAST}),
reach AS (SELECT vec_id, vec_id AS r FROM told UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
roots AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
copies AS (SELECT label, v, count(*) AS n FROM vecs GROUP BY label, v)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links, r.component_id, r.vec_id = r.component_id AS kept, coalesce(c.n, 1) AS n_copies
FROM roots r LEFT JOIN vecs USING (vec_id) LEFT JOIN copies c ON vecs.label = c.label AND vecs.v = c.v
"""
