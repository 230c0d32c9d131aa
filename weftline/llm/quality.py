"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is two log odds, that it is good and that it is toxic, from classifiers over its words and its
surface. They are fitted on a sample of labelled documents of at most ``fit_rows`` rows (a bound of the fit alone: what is
scored, and every count below, covers all documents). Their texts stay on the executors, which count terms and make features.
Of labels that disagree about a doc_id, the least quality counts, and then the most toxic; of texts that repeat one, the least.

Documents come from hosts, and within these from paths. Grouped aggregation sums the evidence of each path and host. A host's
rate is shrunk toward the global rate, and a path's toward its host's, by as much as rates of sites differ beyond what chance
explains: a site with few documents takes the prior, one with many speaks for itself. A document's posterior is its own log
odds, moved from the global rate to the rate of its path.

A document is rejected when its posterior of being toxic, or of not being good, is over ``reject``. Null texts count as
empty; empty texts have no words, so only their surface speaks. Null hosts or paths are a site of their own. Documents repeat
as they are: each row counts and is scored. No rows give no rows; without labels, texts are taken as good. Extra columns are
carried or left unread, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batches_of, bounded_batches, cut, text_bytes

FIT_ROWS = 6000
#: Sites that are broadcast to the rows; if there are more, rows and sites are shuffled to each other.
SITES = 20_000
REJECT = 0.5
TARGETS = ("good", "toxic")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-!|\"():;?")
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_STEMS = (5, 6, 7)


def words_of(text: bytes) -> set[bytes]:
    """Distinct words, and their stems: the first bytes of longer words, marked."""
    words = set(text.translate(_SPLIT).lower().split())
    stems = [{w[:n] + b"~" for w in words if len(w) > n} for n in _STEMS]
    return words.union(*stems)


def surface(text: bytes) -> list[float]:
    """Shares of kinds of characters, and how words and lines run; each about 0 to 1."""
    size, tokens = max(len(text), 1), text.split()
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = text.split(b"\n")
    many = max(len(tokens), 1)
    shares = [share(_UPPER), share(_DIGIT), share(_SIGNS), share(b"!"), share(b"|"), sum(map(eq, tokens, tokens[1:])) / many]
    return [
        1.0,
        *shares,
        *map(math.sqrt, shares),
        len(set(tokens)) / many,
        len(set(lines)) / max(len(lines), 1),
        min(1.0, len(text) / many / 20),
        math.log1p(len(tokens)) / 10,
        min(1.0, text.count(b"\n") / many),
    ]


SURFACE = len(surface(b""))


@dataclass
class Evidence:
    """The fitted classifiers: for each target, weights of words that tell, and of the surface with the sum of these."""

    words: dict[str, dict[bytes, float]] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def log_odds(self, text: bytes) -> tuple[float, float]:
        words, shape = words_of(text), surface(text)
        out = []
        for t in TARGETS:
            told = self.words[t]
            out.append(float(np.clip(self.weights[t] @ _features(shape, words, {w: told[w] for w in words & told.keys()}), -12, 12)))
        return tuple(out)


def _features(shape: list[float], words: set[bytes], found: dict[bytes, float]) -> list[float]:
    """The surface, then what the terms found weigh, and how many words hold one that speaks for the target."""
    told = [w for w, weight in found.items() if weight > 0]
    stems = {w for w in told if w[-1:] == b"~"}
    held = sum(1 for w in words if w[-1:] != b"~" and (w in found and found[w] > 0 or stems and any(w[:n] + b"~" in stems for n in _STEMS if len(w) > n))) if told else 0
    weights = found.values()
    return [*shape, math.fsum(weights) / 10, max(weights, default=0.0) / 5, min(weights, default=0.0) / 5, math.log1p(held), float(held > 1)]


def _informative(a: np.ndarray, b: np.ndarray, n0: int, n1: int, terms: int) -> np.ndarray:
    """A weight for each term: its log odds ratio, smoothed, where the classes differ in it beyond chance, and else 0.

    a and b: in how many of the n0 and n1 texts of the classes it is. Beyond chance: by a likelihood ratio test whose bar rises
    with the number of terms that are tried.
    """
    share = (a + b) / max(n0 + n1, 1)
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    g = 2 * (part(b, n1 * share) + part(a, n0 * share) + part(n1 - b, n1 * (1 - share)) + part(n0 - a, n0 * (1 - share)))
    ratio = np.log((b + 0.5) / (n1 - b + 0.5)) - np.log((a + 0.5) / (n0 - a + 0.5))
    g[a + b < 4] = 0
    return np.where(g > 2 * np.log(max(terms, 1)) + 2, ratio, 0.0)


#: A text's cell: which half it is in, and its two labels. Weights are wanted of terms in the half of even rows, of odd ones, and in all.
CELLS = [(half, good, toxic) for half in (0, 1) for good in (0, 1) for toxic in (0, 1)]
PARTS = [(halves, target) for halves in ((0,), (1,), (0, 1)) for target in TARGETS]


def _counted(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple]:
    """From (cell, text): each term, and in how many texts of each cell it is."""
    counts: dict[bytes, list[int]] = {}
    for cell, text in rows:
        for w in words_of(text):
            counts.setdefault(w, [0] * len(CELLS))[cell] += 1
    return ((w, *n) for w, n in counts.items())


def _weighed(counts: np.ndarray, texts: np.ndarray, terms: int) -> np.ndarray:
    """The weights of terms (rows) in each of PARTS, from their counts and the numbers of texts in each cell."""
    out = []
    for halves, target in PARTS:
        sides = [[k for k, cell in enumerate(CELLS) if cell[0] in halves and cell[1 + TARGETS.index(target)] == label] for label in (0, 1)]
        out.append(_informative(*(counts[:, side].sum(axis=1).astype(float) for side in sides), *(int(texts[side].sum()) for side in sides), terms))
    return np.column_stack(out)


def _features_of(rows: Iterable[tuple[int, bytes]], told: dict[bytes, list[float]]) -> Iterator[list[list[float]]]:
    """For each text, its features for each target, by the words that the other half has told."""
    for cell, text in rows:
        words, shape, half = words_of(text), surface(text), CELLS[cell][0]
        known = [(w, told[w]) for w in words & told.keys()]
        yield [_features(shape, words, {w: v[k] for w, v in known if v[k]}) for k in (PARTS.index(((1 - half,), t)) for t in TARGETS)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the first weight."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _settled(x: list[np.ndarray], labels: dict[str, np.ndarray], told: dict[bytes, list[float]]) -> Evidence:
    """The classifiers, from features of each target, labels, and weights of terms. A target of one class alone (or no rows at all) gets a constant."""
    made = Evidence()
    for k, target in enumerate(TARGETS):
        y, part = labels[target], PARTS.index(((0, 1), target))
        if len(y) < 8 or not 0 < y.sum() < len(y):
            made.words[target] = {}
            made.weights[target] = np.array([8.0 * (np.mean(y) - 0.5) if len(y) else (2.0 if target == "good" else -4.0)] + [0.0] * (SURFACE + 4))
        else:
            made.words[target] = {w: v[part] for w, v in told.items() if v[part]}
            made.weights[target] = _logistic(x[k], y)
    return made


def fit(texts: list[bytes], labels: dict[str, np.ndarray]) -> Evidence:
    """Two classifiers. Each half of the rows is weighed with words chosen on the other half; then words are chosen on all."""
    cells = [CELLS.index((i % 2, int(labels["good"][i]), int(labels["toxic"][i]))) for i in range(len(texts))]
    words, counts = [], []
    for w, *n in _counted(zip(cells, texts, strict=True)):
        words.append(w)
        counts.append(n)
    weights = _weighed(np.array(counts, np.int64).reshape(-1, len(CELLS)), np.bincount(cells, minlength=len(CELLS)), len(words))
    told = {w: v.tolist() for w, v in zip(words, weights, strict=True) if v.any()}
    x = np.array(list(_features_of(zip(cells, texts, strict=True), told))).reshape(len(texts), len(TARGETS), SURFACE + 5)
    return _settled([x[:, k] for k in range(len(TARGETS))], labels, told)


_TERMS = pa.schema([("term", pa.binary()), *((f"c{k}", pa.int64()) for k in range(len(CELLS)))])
_WEIGHTS = pa.schema([("term", pa.binary()), ("weights", pa.list_(pa.float64()))])
_X = pa.schema([("place", pa.int64()), ("cell", pa.int32()), ("x", pa.list_(pa.float64()))])


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Evidence:
    """Evidence from the fit_rows labelled documents whose ids hash lowest. Labels that are null are left out.

    To the driver come their ids and labels, the terms that tell, and the features of each row: nothing that grows with texts.
    """
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    wary = F.min(F.struct((F.col("quality") > 0).cast("int").alias("good"), (-(F.col("toxic") > 0).cast("int")).alias("clean")))
    told = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(wary.alias("l")).select("doc_id", "l.good", (-F.col("l.clean")).alias("toxic"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # of bounded size
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id")
    ordered = F.row_number().over(Window.orderBy("doc_id")).cast("long") - 1
    rows = cut(texts.groupBy("doc_id", "good", "toxic").agg(F.min("text").alias("text")), 100 * fit_rows)
    placed = rows.select("doc_id", ordered.alias("place"))  # ids alone, as many as are fitted
    cell = F.element_at(F.array(*map(F.lit, range(len(CELLS)))), (F.col("place") % 2 * 4 + F.col("good") * 2 + F.col("toxic") + 1).cast("int"))
    rows = rows.join(F.broadcast(placed), "doc_id").select("place", cell.alias("cell"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((c, t) for b in batches for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from batches_of(_counted(pairs), _TERMS, 16384)

    c = [f"c{k}" for k in range(len(CELLS))]
    counts = rows.select("cell", "text").mapInArrow(count, "term binary, " + ", ".join(f"{x} long" for x in c))
    counts = cut(counts.groupBy("term").agg(*[F.sum(x).alias(x) for x in c]), 100 * fit_rows)
    terms, of_cell = counts.count(), np.zeros(len(CELLS), np.int64)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect():
        of_cell[r["cell"]] = r["n"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = _weighed(np.column_stack([batch.column(x).to_numpy(zero_copy_only=False) for x in c]), of_cell, terms)
            tell = np.flatnonzero(weights.any(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tell)), pa.array(weights[tell].tolist(), _WEIGHTS.field(1).type)], schema=_WEIGHTS)

    telling = {bytes(r["term"]): list(r["weights"]) for r in counts.mapInArrow(weigh, "term binary, weights array<double>").collect()}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, cell, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                (x,) = _features_of([(cell, text)], telling)
                yield pa.RecordBatch.from_pylist([{"place": place, "cell": cell, "x": [v for part in x for v in part]}], _X)

    made = sorted(rows.mapInArrow(make, "place long, cell int, x array<double>").collect())  # fit_rows rows of fixed size
    x = np.array([r["x"] for r in made]).reshape(len(made), len(TARGETS), SURFACE + 5)
    at = [CELLS[r["cell"]] for r in made]
    return _settled([x[:, k] for k in range(len(TARGETS))], {t: np.array([float(cell[1 + k]) for cell in at]) for k, t in enumerate(TARGETS)}, telling)


def scores(evidence: Evidence):
    """A column function from texts (binary) to their log odds of being good and toxic."""
    kind = pa.struct([(t, pa.float64()) for t in TARGETS])

    @F.arrow_udf("struct<good:double,toxic:double>")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(TARGETS, evidence.log_odds(t), strict=True)) for t in texts.to_pylist()], kind)

    return scored


def _rate(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _site_sums(scored: DataFrame, rows: int) -> DataFrame:
    return cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(_rate(F.col(t))).alias(t) for t in TARGETS]), rows)


def site_priors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """From rows (host, path, good, toxic): each path's shrunken log odds (host, path, prior_good, prior_toxic), and the global ones.

    The strength of a prior (in documents) is m (1 - m) / v - 1, for the mean m of rates and their variance v beyond chance.
    """
    rows = scored.count()
    paths = _site_sums(scored, rows)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    whole = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_{t}").alias(t) for t in TARGETS]).first()
    mean = {t: min(max((whole[t] or 0.0) / (whole["n"] or 1), 1e-4), 1 - 1e-4) for t in TARGETS}

    def strength(groups: DataFrame, n: str, sums: dict[str, str]) -> dict[str, float]:
        parts = []
        for t, c in sums.items():
            m = mean[t]
            excess = F.col(n) * F.pow(F.col(c) / F.col(n) - m, 2) - m * (1 - m)
            parts.append(F.try_divide(F.sum(excess), F.sum(n) - F.try_divide(F.sum(F.pow(F.col(n), 2)), F.sum(n))).alias(t))
        got = groups.agg(*parts).first()
        out = {}
        for t in sums:
            v = got[t] if got[t] is not None and got[t] == got[t] and got[t] > 0 else 0.0
            out[t] = min(max(mean[t] * (1 - mean[t]) / v - 1, 5.0), 1e5) if v else 1e5
        return out

    of_host = strength(hosts, "host_n", {t: f"host_{t}" for t in TARGETS})
    of_path = strength(paths, "n", {t: t for t in TARGETS})
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    out = joined
    for t in TARGETS:
        host = (of_host[t] * mean[t] + F.col(f"host_{t}")) / (of_host[t] + F.col("host_n"))
        path = (of_path[t] * host + F.col(t)) / (of_path[t] + F.col("n"))
        out = out.withColumn(f"prior_{t}", F.log(path / (1 - path)))
    odds = {t: float(np.log(mean[t] / (1 - mean[t]))) for t in TARGETS}
    return cut(out.select("host", "path", *[f"prior_{t}" for t in TARGETS]), rows), odds


def _posterior(odds: dict[str, float], target: str) -> Column:
    return _rate(F.col(target) + F.col(f"prior_{target}") - F.lit(odds[target]))


def _judged(scored: DataFrame, kept: list[str], reject: float) -> DataFrame:
    """From rows (host, path, good, toxic and what is kept), cut from their lineage: what is kept, posteriors and keep."""
    priors, odds = site_priors(scored)
    sites = priors.withColumnsRenamed({"host": "h", "path": "p"})
    few = priors.limit(SITES + 1).count() <= SITES
    both = scored.join(F.broadcast(sites) if few else sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    told = both.select(*kept, *[_posterior(odds, t).alias(f"p_{t}") for t in TARGETS], *[_rate(F.col(t)).alias(f"own_{t}") for t in TARGETS])
    return told.withColumn("keep", (F.col("p_toxic") <= reject) & (F.col("p_good") >= 1 - reject))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """(row, p_good, p_toxic, own_good, own_toxic, keep): row holds the columns of docs, whatever their names.

    Each text is scored once. The rows are kept in the shared folder with their two numbers, for the sums of sites and for what
    follows; no text is shuffled unless there are more than SITES sites.
    """
    bounded_batches(docs.sparkSession)
    score = scores(sample(docs, labels, fit_rows))
    host, path = (F.col("source") if host is None else host), (F.col("lang") if path is None else path)
    placed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), host.alias("host"), path.alias("path"), score(text_bytes()).alias("s"))
    return _judged(cut(placed.select("row", "host", "path", "s.*")), ["row"], reject)


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """doc_id, p_good, p_toxic (posteriors), own_good, own_toxic (the document's own) and keep, for each row of docs (doc_id, text, source, lang).

    Each text is scored once: its two numbers are kept in the shared folder for the sums of sites and for the rows.
    """
    bounded_batches(docs.sparkSession)
    score = scores(sample(docs, labels, fit_rows))
    scored = docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), score(text_bytes()).alias("s"))
    return _judged(cut(scored.select("doc_id", "host", "path", "s.*")), ["doc_id"], reject)
