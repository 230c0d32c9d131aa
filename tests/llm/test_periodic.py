from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
from helpers import DOCS, SF, clashing, docs, texts
from weftline.llm.periodic import branching_repeats, find_runs, numbered, runs_of, suffix_tree
from weftline.llm.registry import op12_periodic_runs


def plain_runs(words, shortest=24, periods=3):
    """Of each period, the longest stretches of words that equal those a period on; of equal stretches, the smallest period."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    inside = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    kept = " ".join(w for i, w in enumerate(words) if i not in inside)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_suffixes_are_sorted_and_depths_are_common_words():
    rng = random.Random(3)
    for k in (1, 2, 4):
        words = [rng.randrange(k) for _ in range(90)]
        tree = suffix_tree(np.array(words))
        order = sorted(range(90), key=lambda i: words[i:])
        assert tree.leaves.tolist() == order and tree.place[order].tolist() == list(range(90))
        for at in range(1, 90):
            a, b = words[order[at - 1] :], words[order[at] :]
            assert tree.depth[at] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_branching_repeats_are_all_squares_that_do_not_go_on():
    rng = random.Random(5)
    for k in (1, 2, 3):
        words = [rng.randrange(k) for _ in range(70)]
        n = len(words)
        starts, periods = branching_repeats(suffix_tree(np.array(words)), np.full(n, n))
        want = {(i, p) for p in range(1, n) for i in range(n - 2 * p + 1) if words[i : i + p] == words[i + p : i + 2 * p] and words[i + 2 * p : i + 2 * p + 1] != words[i + p : i + p + 1]}
        assert sorted(zip(starts.tolist(), periods.tolist())) == sorted(want)  # each once


def test_runs_of_several_texts_against_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        numbers, deepest, want, first = [], [], [], 0
        shortest, periods = rng.choice([2, 4, 6, 24]), rng.choice([2, 3])
        for _ in range(rng.randint(1, 3)):
            words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if words and rng.random() < 0.6:
                a, p = rng.randrange(len(words)), 1 + rng.randrange(max(1, len(words) // 4))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
            numbers.append(numbered([b"%d" % w for w in words], first))
            deepest += [len(words) // periods] * len(words)
            want += [(s + first, length, q) for s, length, q in plain_runs(words, shortest, periods)]
            first += len(words)
        assert runs_of(np.concatenate(numbers), np.array(deepest, np.int64), shortest, periods) == sorted(want, key=lambda r: (r[0], r[2]))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    few = {i for i, t in rows if len(t) < 12_000}  # the plain version is quadratic
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and len(few) > 900
    assert all(got[i] == plain_row(i, t) for i, t in rows if i in few)
    assert sum(r[1] > 0 for r in got.values()) > 50


def test_odd_rows_and_clashing_columns(spark):
    frame = docs(spark)
    rows = frame.collect()
    got = find_runs(frame, outputs=True).collect()
    assert len(got) == len(rows)
    long = next(r for r in got if r.doc_id == 7)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 40000, 1, 40_000_000)
    assert long.collapsed == "word" and long.runs == [[0, 40000, 1]] and long.n_dropped == 39999
    assert all(r.n_runs == 0 and r.start is None and r.runs == [] for r in got if r.doc_id != 7)
    assert next(r for r in got if r.doc_id == 3).collapsed == ""
    assert sum(r.doc_id is None for r in got) == 2
    assert find_runs(clashing(spark)).count() == 6


def test_repeated_passages_collapse_to_one(spark):
    body = " ".join(f"w{i}" for i in range(11))
    found = find_runs(texts(spark, f"before {body} {body} {body} after", f"{body} {body}")).orderBy("doc_id").collect()
    assert found[0].collapsed == f"before {body} after" and found[0].runs == [[1, 33, 11]]
    assert found[1].n_runs == 0  # two periods are no run


def test_long_periodic_texts_take_no_quadratic_time():
    began = time.time()
    for words in (["a"] * 200_000, [str(i % 3) for i in range(100_000)]):
        x = numbered([w.encode() for w in words])
        assert len(runs_of(x, np.full(len(x), len(x) // 3))) == 1
    a, b = "a", "ab"
    while len(b) < 30_000:
        a, b = b, b + a
    x = numbered([c.encode() for c in b])
    assert runs_of(x, np.full(len(x), len(x) // 3))
    assert time.time() - began < 30


def test_no_rows(spark):
    assert find_runs(spark.createDataFrame([], DOCS)).count() == 0
