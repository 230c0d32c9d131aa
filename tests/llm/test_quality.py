from __future__ import annotations

import random

import numpy as np
from helpers import DOCS, SF, clashing, docs
from weftline.llm.quality import classify, fit, sample, score_documents, site_priors

BIG = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    frame, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 2 = 0")
    told = score_documents(frame, known).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = (told.quality == 1) & (told.toxic == 0)
    assert told.keep[clean].mean() > 0.97 and (~told.keep[told.quality == 0]).mean() > 0.95 and (~told.keep[told.toxic == 1]).mean() > 0.8


def test_site_rates_shrink_toward_their_priors(spark):
    rows = [("big", "a", 4.0, -4.0)] * 300 + [("bad", "a", -4.0, 4.0)] * 200 + [("bad", "b", -4.0, 4.0), ("new", "a", -4.0, 4.0), (None, None, 4.0, -4.0)]
    priors, odds = site_priors(spark.createDataFrame(rows, "host string, path string, good double, toxic double"))
    of = {(r.host, r.path): r.prior_toxic for r in priors.collect()}
    assert of["bad", "a"] > of["bad", "b"] - 1e-9 > of["new", "a"] > of["big", "a"] and of[None, None] < odds["toxic"]


def shrunk(sites, odds):
    """Posteriors of rows at sites (host, path) with these log odds, written down plainly: sums by site in dictionaries, no grouped aggregation."""
    own = 1 / (1 + np.exp(-np.asarray(odds)))
    mean = np.clip(own.mean(), 1e-4, 1 - 1e-4)
    at_host, at_path = ({s: own[[i for i, x in enumerate(sites) if x[:k] == s]] for s in {x[:k] for x in sites}} for k in (1, 2))

    def strength(groups):
        n, rate = np.array([len(v) for v in groups.values()]), np.array([v.mean() for v in groups.values()])
        spread = (n * (rate - mean) ** 2 - mean * (1 - mean)).sum() / (n.sum() - (n**2).sum() / n.sum())
        return np.clip(mean * (1 - mean) / spread - 1, 5, 1e5) if spread > 0 else 1e5

    of_host, of_path, out = strength(at_host), strength(at_path), []
    for site, log_odds in zip(sites, odds, strict=True):
        h, p = at_host[site[:1]], at_path[site]
        host = (of_host * mean + h.sum()) / (of_host + len(h))
        path = (of_path * host + p.sum()) / (of_path + len(p))
        out.append(1 / (1 + np.exp(-(log_odds + np.log(path / (1 - path)) - np.log(mean / (1 - mean))))))
    return out


def test_posteriors_of_every_row_against_numpy(spark):
    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(frame, labels).join(frame.select("doc_id", "source", "lang"), "doc_id").collect()
    assert len(rows) == frame.count()
    for t in ("good", "toxic"):
        own = np.array([r[f"own_{t}"] for r in rows])
        want = shrunk([(r.source, r.lang) for r in rows], np.log(own / (1 - own)))
        assert max(abs(r[f"p_{t}"] - w) for r, w in zip(rows, want, strict=True)) < 1e-9
    assert all(r.keep == (r.p_toxic <= 0.5 and r.p_good >= 0.5) for r in rows)


def test_fit_on_executors_is_the_fit_in_memory(spark):
    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = frame.join(labels.filter("quality is not null and toxic is not null"), "doc_id").orderBy("doc_id").collect()
    want = fit([(r.text or "").encode() for r in rows], {"good": np.array([float(r.quality) for r in rows]), "toxic": np.array([float(r.toxic) for r in rows])})
    got = sample(frame, labels)
    assert got.words == want.words and all(np.allclose(got.weights[t], want.weights[t], rtol=1e-9, atol=1e-9) for t in want.weights)


def test_repeated_ids_fit_the_same_each_time(spark):
    """Rows of one id with other texts, and labels that disagree, in any order."""
    rng = random.Random(4)
    rows = [(i % 40, " ".join(rng.choice(["fine", "plain", "word", "bad", "junk"]) + str(rng.randrange(9)) for _ in range(30)), "en", "s", 1) for i in range(120)]
    told = [(i % 40, rng.randrange(2), rng.randrange(2)) for i in range(120)]
    made = []
    for _ in range(2):
        rng.shuffle(rows)
        rng.shuffle(told)
        made.append(sample(docs(spark, rows), spark.createDataFrame(told, LABELS)))
    assert made[0].words == made[1].words and all(np.array_equal(made[0].weights[t], made[1].weights[t]) for t in made[0].weights)


def test_one_class_and_no_labels(spark):
    assert fit([], {"good": np.array([]), "toxic": np.array([])}).log_odds(b"text")[0] > 0
    none = spark.createDataFrame([], LABELS)
    assert classify(docs(spark), none).filter("keep").count() == 11
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, 0), (5, None, 1), (5, 1, 0)], LABELS)
    assert sample(docs(spark), ones).words == {"good": {}, "toxic": {}}


def test_rows_and_columns_stay_whole(spark):
    none = spark.createDataFrame([], LABELS)
    assert classify(docs(spark), none).select("row.*").columns == docs(spark).columns
    assert score_documents(docs(spark), none).count() == 11
    empty = spark.createDataFrame([], DOCS)
    assert score_documents(empty, none).count() == 0 and classify(empty, none).count() == 0
    clash = clashing(spark).withColumnsRenamed({"key": "source", "token": "lang"})
    assert classify(clash, none).select("row.*").columns == clash.columns


def test_all_telling_terms_count_in_each_language():
    """Words of a rarer language tell less each, and there are more telling words than 80."""
    rng = random.Random(2)
    plain = {lang: [f"{lang}{i}" for i in range(40)] for lang in ("en", "es")}
    foul = {lang: [f"{lang}z{i}" for i in range(60)] for lang in ("en", "es")}
    rows = [(lang, toxic) for lang, n in (("en", 300), ("es", 120)) for toxic in (0, 1) for _ in range(n)]
    texts_of = [" ".join(rng.sample(plain[lang], 20) + (rng.sample(foul[lang], 20) if toxic else rng.sample(plain[lang], 20))).encode() for lang, toxic in rows]
    toxic = np.array([float(t) for _, t in rows])
    half = np.arange(len(rows)) % 2 == 0
    made = fit([t for t, h in zip(texts_of, half, strict=True) if h], {"good": np.ones(half.sum()), "toxic": toxic[half]})
    assert {w.encode() for words in foul.values() for w in words} <= made.words["toxic"].keys()
    for lang in ("en", "es"):
        held_out = [t for t, (of, bad), h in zip(texts_of, rows, half, strict=True) if of == lang and bad and not h]
        assert np.mean([made.log_odds(t)[1] > 0 for t in held_out]) > 0.95


def test_toxic_recall_per_language(spark):
    frame, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    odd = labels.filter("doc_id % 2 = 1 and toxic = 1")
    told = score_documents(frame, labels.filter("doc_id % 2 = 0")).join(odd, "doc_id").join(frame.select("doc_id", "lang"), "doc_id").toPandas()
    assert set(told.lang) == {"en", "de", "fr", "es"} and ((~told.keep).groupby(told.lang).mean() > 0.8).all()
