"""How sources differ in their words, from joint histograms of counts.

Each language keeps the terms that are in at least LEAST_DOCS of its documents. A group (language, source) gives each kept term a
share p in billionths, with one added to every count; f = floor((p - q)^2 / q) compares two shares. Two sources are compared by the
sum of f over all kept terms, a source with its language by the terms that it has more of.

The sum over terms is never taken term by term. f depends on the two counts alone, so for each pair of sources the terms are
tallied by (count, count); f is evaluated once for each combination and multiplied. Only the combinations of two counts above
zero come from a join, on the term. The others follow: of the terms that one source holds n times, those not met in the other
are (n, 0), and what is left of all kept terms is (0, 0). The two directions of a pair share their tally.

Words are counted in each task before anything is shuffled; a source or a word that holds a third of all rows is a sum of
partial sums. All arithmetic is exact, in integers. Null text, language or source counts as empty; rows that repeat count each; columns
besides these are not read; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, UPPER, bounded_batches, cut

LEAST_DOCS, SCALE, MOST_TERMS = 3, 1_000_000_000, 200
SALTS = 16
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # of bytes: all those of letters beyond ASCII are among them
_HELD, _HELD_BYTES, _ROWS = 600_000, 64 << 20, 20_000
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _told(lang: str, source: str, words: Counter, docs: Counter) -> Iterator[pa.RecordBatch]:
    terms = list(words)
    for k in range(0, len(terms), _ROWS):
        part = terms[k : k + _ROWS]
        column = pa.array([t.decode("utf-8", "replace") for t in part], pa.string())
        names = (pa.array([x], pa.string()).take(pa.array([0] * len(part), pa.int32())) for x in (lang, source))
        yield pa.RecordBatch.from_arrays([*names, column, *(pa.array([c[t] for t in part], pa.int64()) for c in (words, docs))], schema=_COUNTED)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of documents by (lang, source, term), handed on whenever there are many of them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            terms = _TERM.findall(text.lower())  # bytes: A-Z only
            if not terms:
                continue
            words, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words.update(terms)
            docs.update(set(terms))
            size += len(text)
        if size > _HELD_BYTES or sum(len(w) for w, _ in held.values()) > _HELD:
            for key, both in held.items():
                yield from _told(*key, *both)
            held, size = {}, 0
    for key, both in held.items():
        yield from _told(*key, *both)


def share(n: Column, total: Column, terms: Column) -> Column:
    """One and the billionths of (n + 1) in (total + terms), rounded down; null without terms."""
    large = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    exact = F.call_function("div", large, (total + terms).cast("decimal(19,0)"))
    fits = n < (1 << 63) // SCALE - 1  # then the product fits a long, which is much faster
    return F.when(terms > 0, F.when(fits, F.call_function("div", (n + 1) * SCALE, total + terms)).otherwise(exact) + 1)


def apart(p: Column, q: Column) -> Column:
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms, for each group that has them. A row that has a term counts as a document.

    first: whether the source is the smallest of those that have the term.
    """
    bounded_batches(docs.sparkSession)
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = filled.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # Dealt once, by term: a task has counted already, so that the most frequent word is a row for each task and source.
    groups = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source by now
    told = groups.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"), F.sum("docs").over(term).alias("lang_docs")
    )
    return cut(told.filter(F.col("lang_docs") >= least_docs).drop("lang_docs"))


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total) of every group that occurs, of which total is over the kept terms."""
    all_ = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("terms"))
    langs = own.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("total").alias("lang_total"))
    filled = all_.join(own.drop("terms"), ["lang", "source"], "left").join(langs, "lang", "left")
    return filled.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")))


def _pairs(groups: DataFrame) -> DataFrame:
    """(lang, a, b, terms, total_a, total_b) of the sources a < b of each language. One language may have them all, so a is salted."""
    zero = F.lit(0).cast("long")
    left = groups.select("lang", F.col("source").alias("a"), "terms", F.col("total").alias("total_a"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.explode(F.sequence(zero, zero + SALTS - 1)).alias("salt"))
    return left.join(right, ["lang", "salt"]).filter("a < b").drop("salt")


def joint_counts(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, many): how many kept terms a pair of sources has so and so often, zeros included."""
    one = counts.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    two = counts.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    keys, zero = ["lang", "a", "b", "na", "nb"], F.lit(0).cast("long")
    both = one.join(two, ["lang", "term"]).filter("a < b").groupBy(*keys).agg(F.count("*").alias("many"))

    def cells(*of: tuple[Column, Column, Column]) -> Column:
        return F.inline(F.array(*(F.struct(na.alias("na"), nb.alias("nb"), many.alias("many")) for na, nb, many in of)))

    na, nb, many = F.col("x_na"), F.col("x_nb"), F.col("x_many")
    met = both.select("lang", "a", "b", F.col("na").alias("x_na"), F.col("nb").alias("x_nb"), F.col("many").alias("x_many"))
    met = met.select("lang", "a", "b", cells((na, nb, many), (na, zero, -many), (zero, nb, -many), (zero, zero, many)))
    held = counts.groupBy("lang", "source", F.col("n").alias("x_n")).agg(F.count("*").alias("x_many"))
    names = pairs.select("lang", "a", "b")
    ones = names.join(held.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", cells((F.col("x_n"), zero, many), (zero, zero, -many)))
    twos = names.join(held.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", cells((zero, F.col("x_n"), many), (zero, zero, -many)))
    rest = pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), F.col("terms").alias("many"))
    return met.unionByName(ones).unionByName(twos).unionByName(rest).groupBy(*keys).agg(F.sum("many").alias("many"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its language (part pair), and the terms that it has more of (part term), the first most_terms of them."""
    counts = term_counts(docs, least_docs)
    groups = cut(_groups(docs, counts), 0)
    pairs = _pairs(groups)
    tally = joint_counts(counts, pairs)
    told = tally.join(groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms"), ["lang", "a"])
    told = told.join(groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b")), ["lang", "b"])
    shares = told.select("lang", "a", "b", "many", share(F.col("na"), F.col("total_a"), F.col("terms")).alias("p"), share(F.col("nb"), F.col("total_b"), F.col("terms")).alias("q"))
    sums = shares.groupBy("lang", "a", "b").agg(
        F.coalesce(F.sum(F.col("many") * apart(F.col("p"), F.col("q"))), F.lit(0)).alias("ab"), F.coalesce(F.sum(F.col("many") * apart(F.col("q"), F.col("p"))), F.lit(0)).alias("ba")
    )
    ways = F.array(*(F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value")) for s, i, v in (("a", "b", "ab"), ("b", "a", "ba"))))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = sums.select("lang", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    own = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    of_terms = own.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value"))
    of_terms = of_terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most_terms)
    return of_pairs.unionByName(of_terms)


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
words AS (SELECT d, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM grps g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ((coalesce(c.n, 0) + 1) * {SCALE}) // (t.total + l.v) AS p,
                  1 + ((k.n + 1) * {SCALE}) // (l.total + l.v) AS q
           FROM grps g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang JOIN totals t ON g.lang = t.lang AND g.source = t.source
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT p.lang, p.source, 'pair' AS part, p.item, coalesce(s.value, 0) AS value
         FROM pairs p LEFT JOIN sums s ON p.lang = s.lang AND p.source = s.source AND p.item = s.item
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
