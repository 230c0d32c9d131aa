"""Gated, diversified retrieval of parts by vector and shape, and its lexical and pooled forms.

Gates and exclusions come first, as native predicates, so that only what may be returned is scored. A stated set of queries is
a broadcast of a size that the caller states; scores of a candidate are the maximum over queries. Two forms give the same
scores: native (higher-order functions) for a few queries, and a matrix product over Arrow batches for many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import shapes
from weftline.operators.keyed import first_by


@dataclass(frozen=True)
class Limits:
    """The thresholds of retrieval."""

    floor: float = 0.30
    saturation: float = 0.58
    reject: float = 0.72
    signature: float = 0.60
    symmetry: float = 0.40
    diversity: float = 6.0
    duplicate: float = 0.86
    first_cut: int = 2000
    top: int = 8


def gated(library: DataFrame, sig: Column, sym: Column, limits: Limits = Limits(), free: bool = False) -> DataFrame:
    """Candidates near the slot in shape and symmetry, with their gaps d_sig and d_sym. free: every shape passes."""
    gaps = library.withColumns({"d_sig": shapes.signature_gap(F.col("sig"), sig), "d_sym": F.abs(F.col("sym") - sym)})
    return gaps if free else gaps.filter((F.col("d_sig") <= limits.signature) & (F.col("d_sym") <= limits.symmetry))


def literally_rejected(caption: Column, words: list[str]) -> Column:
    """Whether a caption has one of some words, as whole words in any case."""
    if not words:
        return F.lit(False)
    escaped = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in words)
    return caption.rlike(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{escaped})(?:$|[^A-Za-z0-9_])")


def similarity(candidates: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """candidates with the largest dot product to a few queries (column vec), natively; null without queries."""
    asked = queries.agg(F.collect_list("vec").alias("_asked"))
    best = F.array_max(F.transform("_asked", lambda q: shapes.dot(q, F.col("vec"))))
    return candidates.crossJoin(F.broadcast(asked)).withColumn(name, best).drop("_asked")  # one row, of the stated queries


def similarity_matrix(candidates: DataFrame, queries: np.ndarray, name: str) -> DataFrame:
    """The same for many queries, given as rows of a matrix: a product for each Arrow batch."""
    schema = T.StructType([*candidates.schema.fields, T.StructField(name, T.DoubleType())])
    names = [*candidates.columns, name]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = np.array(batch.column("vec").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            best = (vecs @ queries.T).max(axis=1) if batch.num_rows and len(queries) else np.full(batch.num_rows, np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.float64())], names=names)

    return candidates.mapInArrow(product, schema)


#: Rows of a block of candidates, and queries or slots of a block; a task holds one of each.
ROWS, ASKED, SALTS = 2048, 256, 64
#: Numbers (of 8 bytes) up to which a side is sent to all tasks.
MOST_VALUES = 1 << 20


def _blocks(df: DataFrame, key: str, each: int) -> tuple[DataFrame, int]:
    """df with block, a number by the hash of its key, and how many blocks there are: about as many rows in each."""
    many = max(1, -(-df.count() // each))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(many))), many


def _met(left: DataFrame, right: DataFrame, key: tuple[str, str], work: Callable, schema: T.StructType | str, values: Column) -> DataFrame:
    """work(part of left, part of right), for parts that cover all pairs.

    values: how many numbers a row of right holds. Up to MOST_VALUES of them in all, right goes to every task as it is, and left stays
    where it is; beyond, both are dealt in blocks, and each pair of blocks meets.
    """
    if (right.agg(F.coalesce(F.sum(values), F.lit(0)).alias("n")).first()["n"]) <= MOST_VALUES:
        held = left.sparkSession.sparkContext.broadcast(right.toPandas())

        def each(frames: Iterator) -> Iterator:
            for pdf in frames:
                for i in range(0, len(pdf), ROWS):
                    for j in range(0, len(held.value), ASKED):  # a part of each, as in blocks: what they make must fit, too
                        yield work(pdf.iloc[i : i + ROWS], held.value.iloc[j : j + ASKED])

        return left.mapInPandas(each, schema)
    renamed = right.select(*[F.col(c).alias(c) for c in right.columns])  # both may come from one table
    (a, m), (b, n) = _blocks(left, key[0], ROWS), _blocks(renamed, key[1], ASKED)
    a = a.withColumnRenamed("block", "a").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    b = b.withColumnRenamed("block", "b").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(work, schema)


def _matrix(vecs) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vecs])


def similarity_blocks(candidates: DataFrame, queries: DataFrame, name: str, key: str = "pid") -> DataFrame:
    """(key, name): the largest dot product of each candidate (key, vec) to a stated set of queries (the same columns), which may be many."""

    def work(mine, asked):
        import pandas as pd

        if not len(mine) or not len(asked):
            return pd.DataFrame({key: [], name: []})
        return pd.DataFrame({key: mine[key], name: (_matrix(mine["vec"]) @ _matrix(asked["vec"]).T).max(axis=1)})

    kind = dict(candidates.dtypes)[key]
    of = lambda df: df.select(key, F.col("vec").cast("array<double>").alias("vec"))
    return _met(of(candidates), of(queries), (key, key), work, f"{key} {kind}, {name} double", F.size("vec") + 8).groupBy(key).agg(F.max(name).alias(name))


def for_slots(library: DataFrame, slots: DataFrame, limits: Limits = Limits(), rejects: bool = False, top: bool = True) -> DataFrame:
    """What each slot may take from a library, in one plan: (slot, pid, oid, s_acc, s_rej, score).

    library: (pid, oid, vec, sig, sym). slots: (slot, oid, sig, sym, asked and rejected: arrays of vectors, without: ids that are
    left out). A slot's own source, what it excludes and what fails its gates are not scored; with top, the limits.top best remain,
    one from a source. Slots and library meet block by block. A block passes on, for each slot, the best of each source and the
    top of these: a source among the best of all is among the best of its block, so nothing is lost.
    """

    def work(mine, asked):
        import pandas as pd

        out = []
        if len(mine):
            vecs, sig, sym = _matrix(mine["vec"]), _matrix(mine["sig"]), mine["sym"].to_numpy()
            pid, oid = mine["pid"].to_numpy(), mine["oid"].to_numpy()
        for s in asked.itertuples() if len(mine) else ():
            d_sig, d_sym = np.abs(sig[:, 1:] - np.asarray(s.sig)[1:]).sum(axis=1), np.abs(sym - s.sym)
            open_ = (d_sig <= limits.signature) & (d_sym <= limits.symmetry) & (oid != s.oid) & ~np.isin(pid, s.without)
            at = np.flatnonzero(open_)
            if not len(at) or not len(s.asked):
                continue
            acc = (vecs[at] @ _matrix(s.asked).T).max(axis=1)
            rej = (vecs[at] @ _matrix(s.rejected).T).max(axis=1) if len(s.rejected) else np.full(len(at), -np.inf)
            score = 10.0 * (np.minimum(acc, limits.saturation) + 0.25 * np.maximum(acc - limits.saturation, 0.0)) - 1.5 * d_sym[at] - d_sig[at]
            kept = acc >= limits.floor
            if rejects:
                kept &= (rej < limits.reject) & (acc > rej)
            told = pd.DataFrame({"slot": s.slot, "pid": pid[at], "oid": oid[at], "s_acc": acc, "s_rej": rej, "score": score})[kept]
            if top:
                told = told.sort_values(["score", "pid"], ascending=[False, True]).drop_duplicates("oid").head(limits.top)
            out.append(told)
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("slot", "pid", "oid", "s_acc", "s_rej", "score")})

    mine = library.select("pid", "oid", F.col("vec").cast("array<double>").alias("vec"), "sig", "sym")
    kinds = dict(slots.dtypes) | dict(library.dtypes)
    weight = reduce(lambda a, b: a + b, [F.aggregate(c, F.lit(0), lambda n, v: n + F.size(v)) for c in ("asked", "rejected")]) + F.size("without") + 16
    met = _met(mine, slots, ("pid", "slot"), work, f"slot {kinds['slot']}, pid {kinds['pid']}, oid {kinds['oid']}, s_acc double, s_rej double, score double", weight)
    if not top:
        return met
    best = first_by(met, ["slot", "oid"], [F.desc("score"), F.col("pid")])
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "pid"))).filter(F.col("_r") <= limits.top).drop("_r")


def scored(candidates: DataFrame, limits: Limits = Limits(), rejects: bool = False) -> DataFrame:
    """Candidates (s_acc and, with rejects, s_rej) over the floor and not nearer to a reject, with their score.

    Similarity counts fully up to saturation and by a quarter beyond.
    """
    s = F.col("s_acc")
    kept = candidates.filter(s >= limits.floor)
    if rejects:
        kept = kept.filter((F.col("s_rej") < limits.reject) & (s > F.col("s_rej")))
    effective = F.least(s, F.lit(limits.saturation)) + 0.25 * F.greatest(s - limits.saturation, F.lit(0.0))
    return kept.withColumn("score", 10.0 * effective - 1.5 * F.col("d_sym") - 1.0 * F.col("d_sig"))


def one_per_source(candidates: DataFrame, source: str = "oid", key: str = "pid") -> DataFrame:
    return first_by(candidates, [source], [F.desc("score"), F.col(key)])


def diversified(candidates: DataFrame, group: list[str], limits: Limits = Limits(), source: str = "oid", key: str = "pid") -> DataFrame:
    """Of each group, the top by maximal marginal relevance, with their pick number.

    A pick lowers what is like it, and takes out its duplicates and what else comes from its source. The first cut bounds the
    rows of a group before they meet; it is made by salt first, so that a large group is many tasks.
    """
    best = [F.desc("score"), F.col(key)]
    salted = candidates.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    few = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*best))).filter(F.col("_rank") <= limits.first_cut).drop("_salt", "_rank")
    cut = few.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*best))).filter(F.col("_rank") <= limits.first_cut)
    schema = T.StructType([*candidates.schema.fields, T.StructField("pick", T.IntegerType())])

    def pick(pdf):
        pdf = pdf.sort_values("_rank", ignore_index=True)
        vecs, score, sources = np.array(pdf["vec"].tolist(), float), pdf["score"].to_numpy(), pdf[source].to_numpy()
        like, alive, chosen = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        while alive.any() and len(chosen) < limits.top:
            best = int(np.argmax(np.where(alive, score - limits.diversity * like, -np.inf)))
            chosen.append(best)
            near = vecs @ vecs[best]
            like = np.maximum(like, near)
            alive &= (near < limits.duplicate) & (sources != sources[best])
            alive[best] = False
        return pdf.loc[chosen].drop(columns="_rank").assign(pick=range(1, len(chosen) + 1))

    return cut.groupBy(*group).applyInPandas(pick, schema)


def softmax_order(candidates: DataFrame, key: Column, temperature: float = 0.35, seed: int = 0) -> DataFrame:
    """candidates with draw: their place when drawn without replacement in proportion to exp(score / temperature).

    The Gumbel form: the same distribution as drawing one by one, and the same order whatever the partitions. At temperature 0
    the order of scores stays. Draws of a slot's candidates are ranked in one window, as their list is in the result.
    """
    if temperature <= 0:
        return candidates.withColumn("draw", F.col("score"))
    u = shapes.hashed_uniform(key, seed=seed)
    return candidates.withColumn("draw", F.col("score") / temperature - F.log(-F.log(u)))


def lexical_score(candidates: DataFrame, accepts: Column, words: Column) -> DataFrame:
    """Candidates (kws) that share a word with accepts if there are any, scored by shared words and gaps."""
    hits = F.size(F.array_intersect(F.col("kws"), accepts))
    kept = candidates.withColumn("hits", hits).filter((F.size(accepts) == 0) | (F.col("hits") >= 1))
    shared = F.size(F.array_intersect(F.col("kws"), words))
    return kept.withColumn("score", 6.0 * F.least(F.col("hits"), F.lit(2)) - 1.5 * F.col("d_sym") - F.col("d_sig") + 0.3 * shared)


def pool_order(pool: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """A pool in an order that only the seed and the keys decide."""
    return pool.withColumn("draw", shapes.hashed_uniform(key, seed=seed))
