from __future__ import annotations

import zlib

import numpy as np
from helpers import DOCS, SF

import corpus_pipeline as pipeline
from weftline.llm import quality
from weftline.llm.registry import oracle_sql, queries, word_tokenizer


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept."""
    from test_ngram_join import brute
    from test_packing import check_whole
    from test_pii import base
    from tokenizers import Tokenizer

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, frame, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (frame, after)
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == frame.columns
        frame = after

    rows = lambda f: {r.doc_id: r for r in f.collect()}
    before, after = map(rows, kept["quality_classifier"])
    assert sorted(after) == plain_keep(spark, kept["quality_classifier"][0]) and 0 < len(after) < len(before)
    before, after = map(rows, kept["exact_dedup"])
    groups = {}
    for doc, r in before.items():
        groups.setdefault((r.text or "").encode().lower(), []).append(doc)
    assert sorted(after) == sorted(map(max, groups.values()))
    before, after = map(rows, kept["ngram_jaccard_join"])
    components = brute([(d, r.text) for d, r in before.items()], 5, 80)
    assert sorted(after) == sorted(d for d, _, c in components if d == c)
    before, after = map(rows, kept["pii"])
    assert before.keys() == after.keys() and not any(base(r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert any(base(r.text) for r in before.values()) and all(r == before[d] for d, r in after.items() if "[" not in r.text)
    before, after = kept["best_fit_packing"]
    texts, pieces = {d: r.text or "" for d, r in rows(before).items()}, after.collect()
    by_doc, by_seq = check_whole(pieces, 2048)
    whole = Tokenizer.from_file(word_tokenizer())
    assert {d for d, _ in by_doc} == texts.keys()
    for doc, text in texts.items():
        ids = np.asarray([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted(by_doc[doc, 0], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 8192))) and sum(r.length for r in mine) == len(ids) // 4
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in mine)
    assert len(by_seq) <= 1.01 * -(-sum(r.length for r in pieces) // 2048)


def plain_keep(spark, frame):
    """Ids that stay by the classifier, fitted in memory, with posteriors formed without Spark."""
    from test_quality import shrunk

    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null and toxic is not null").collect()}
    rows = sorted(frame.collect(), key=lambda r: r.doc_id)
    known = [r for r in rows if r.doc_id in labels]
    made = quality.fit([(r.text or "").encode() for r in known], {"good": np.array([float(labels[r.doc_id].quality) for r in known]), "toxic": np.array([float(labels[r.doc_id].toxic) for r in known])})
    odds = np.array([made.log_odds((r.text or "").encode()) for r in rows])
    good, toxic = (shrunk([(r.source, r.lang) for r in rows], odds[:, k]) for k in (0, 1))
    return [r.doc_id for r, g, t in zip(rows, good, toxic, strict=True) if g >= 0.5 and t <= 0.5]


def test_no_rows(spark):
    frame = spark.createDataFrame([], DOCS)
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.count() == 0


def test_registry_is_whole():
    names = queries()
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(oracle_sql()) <= set(names)
