from __future__ import annotations

import hashlib
from collections import defaultdict

from helpers import DOCS, clashing, docs
from weftline.llm.line_dedup import LineRuns, dedup_lines, line_keys

LINE = "This line is shared and long enough to be counted here"


def brute(rows, least=5, chars=40):
    keys, holders = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode(), defaultdict(list)
    for doc, text, *_ in rows:
        for k in {keys(x) for x in (text or "").split("\n")}:
            holders[k].append(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := keys(x)) >= chars and len(holders[k]) >= least and doc != max(holders[k]))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def some_rows():
    rows = [(i, f"own {i}\n  {LINE.upper() if i % 2 else LINE}\t\nmid\n{LINE}{i % 3}", "en", "s", 1) for i in range(23)]
    return [*rows, (50, "é" * 39, "fr", "s", 1), (51, None, "fr", None, None), (52, "", "fr", "s", 0), (53, "\n\n", "fr", "s", 2), (54, f"{LINE}\n" * 3000, "en", "s", 1)]


def test_against_brute_force(spark):
    rows = some_rows()
    for batches, fanout in ((1, 2), (5, 2)):
        found = dedup_lines(docs(spark, rows), n_batches=batches, fanout=fanout)
        assert sorted(map(tuple, found.collect())) == brute(rows)


def test_text_that_stays(spark):
    found = {r.doc_id: r for r in dedup_lines(docs(spark, some_rows()), with_text=True).collect()}
    assert found[0].kept_text == "own 0\nmid" and found[54].n_dropped == 0
    assert hashlib.sha256(found[0].kept_text.encode()).hexdigest() == found[0].kept_sha256


def test_null_and_repeated_ids(spark):
    rows = [(None, LINE, "en", "s", 1)] + [(i, LINE, "en", "s", 1) for i in (1, 2, 3, 4, 4)]
    found = sorted((r.doc_id or -1, r.n_dropped) for r in dedup_lines(docs(spark, rows)).collect())
    assert found == [(-1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)]


def test_runs_compact_and_anti_join(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        keys = line_keys(docs(spark, [(k, f"{LINE}\n{LINE} number {k}", "en", "s", 1)]))
        batch = keys.withColumnsRenamed({"id": "max_doc"})
        assert runs.fresh(batch).count() == (2 if k == 0 else 1)
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.n_docs for r in runs.totals().collect()) == [1] * 5 + [5]
    assert [r.n_docs for r in runs.totals(5).collect()] == [5]
    runs.close()


def test_the_anti_join_carries_the_counts(spark, monkeypatch):
    """Without its survivors nothing is dropped; with all rows as survivors, counts of batches are not added up."""
    rows = some_rows()
    want = sum(n for _, _, n, _ in brute(rows))
    fresh = LineRuns.fresh
    found = {}
    for name, wrong in (("right", fresh), ("none", lambda self, batch: batch.limit(0)), ("all", lambda self, batch: batch)):
        monkeypatch.setattr(LineRuns, "fresh", wrong)
        found[name] = sum(r.n_dropped for r in dedup_lines(docs(spark, rows), n_batches=5, fanout=2).collect())
    assert found["right"] == want and found["none"] == 0 and found["all"] != want


def test_merges_shuffle_nothing(spark):
    runs = LineRuns(spark, fanout=3)
    for k in range(2):
        runs.add(line_keys(docs(spark, [(k, f"{LINE}\n{LINE} number {k}", "en", "s", 1)])))
    batch = spark.table(runs.levels[0][0])
    plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    runs.close()


def test_no_rows_and_clashing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    assert dedup_lines(clashing(spark)).count() == 6
