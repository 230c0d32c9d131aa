from __future__ import annotations

import hashlib

from helpers import DOCS, clashing, docs
from weftline.llm.exact_dedup import exact_duplicates, without_duplicates


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault((text or "").encode().lower(), []).append(doc)
    return groups


def test_odd_rows_against_brute_force(spark):
    frame = docs(spark)
    groups = brute([tuple(r) for r in frame.collect()])
    found = exact_duplicates(frame, salts=3).collect()
    assert len(found) == frame.count()
    by_hash = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for h in by_hash:
        assert sum(r.kept for r in found if r.text_sha256 == h) == 1  # of repeated rows, too, one stays
    assert next(r for r in found if r.kept and r.group_size == 5).doc_id == 8


def test_only_ascii_letters_fold(spark):
    found = {r.doc_id: r.group_size for r in exact_duplicates(docs(spark)).collect()}
    assert found[5] == found[6] == 1


def test_rows_that_stay_keep_all_columns(spark):
    frame = docs(spark)
    kept = without_duplicates(frame)
    assert kept.columns == frame.columns and kept.count() == 6
    assert without_duplicates(clashing(spark)).columns == clashing(spark).columns


def test_salts_and_partitions_do_not_matter(spark):
    frame = docs(spark, [(i, f"text {i % 7}", "en", "s", 6) for i in range(500)])
    one = sorted(map(tuple, exact_duplicates(frame, salts=1).collect()))
    assert one == sorted(map(tuple, exact_duplicates(frame.repartition(9, "doc_id"), salts=16).collect()))


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_duplicates(empty).count() == 0 and without_duplicates(empty).count() == 0
