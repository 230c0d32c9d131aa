from __future__ import annotations

import random

import numpy as np
from helpers import DOCS, clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from weftline.llm.components import connected
from weftline.llm import ngram_join
from weftline.llm.ngram_join import apart, near_duplicates, near_links, overlap_needed, parity, suffix_bound, without_near_duplicates


def sets(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}


def brute(rows, width, percent):
    """n_shingles and component of each row, by comparing all pairs."""
    made = [(r[0], sets(r[1], width)) for r in rows]
    parent = list(range(len(made)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            a, b = made[i][1], made[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, s) in enumerate(made):
        if s and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, (doc, s) in enumerate(made)), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(40))
    passage, rows = " ".join(word() for _ in range(25)), []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    chain = [word() for _ in range(60)]  # each links with the next, not with those further on
    for _ in range(8):
        rows.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    rows += rows[:5] + ["one two", "ONE two", "one", "", None, " \t\n"]
    rng.shuffle(rows)
    return [(i, t, "en", "s", 1) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    for width, percent in ((4, 85), (2, 60)):
        found = near_duplicates(docs(spark, rows), width, percent).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, width, percent)


def test_all_links_are_counted_and_listed(spark, monkeypatch):
    """Also links between copies of a centre, in blocks of few nodes."""
    rows = corpus()
    base = [f"w{i}" for i in range(60)]
    rows += [(1000 + k, " ".join([*base[:k], f"x{k}", *base[k:]]), "en", "s", 1) for k in range(0, 60, 3)]
    for block, width, percent in ((256, 4, 85), (3, 2, 60)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        made = {r[0]: frozenset(sets(r[1], width)) for r in rows}
        texts = sorted({s for s in made.values() if s}, key=sorted)
        links = {frozenset((x, y)) for i, x in enumerate(texts) for y in texts[:i] if 100 * len(x & y) >= percent * len(x | y)}
        found = near_duplicates(docs(spark, rows), width, percent).collect()
        class_of = {r.class_id: made[r.doc_id] for r in found if r.n_shingles}
        assert {r.doc_id: r.n_links for r in found} == {doc: sum(s in pair for pair in links) for doc, s in made.items()}
        listed = [frozenset((class_of[r.a], class_of[r.b])) for r in near_links(docs(spark, rows), width, percent).collect()]
        assert len(listed) == len(links) and set(listed) == links


def test_salted_shingles_against_all_pairs(spark, monkeypatch):
    """Shingles of many nodes are dealt by salt; centres of salts find each other."""
    rows = corpus(11)
    base = [f"w{i}" for i in range(60)]
    rows += [(1000 + k, " ".join([*base[:k], f"x{k}", *base[k:]]), "en", "s", 1) for k in range(60)]
    for hot in (2, 10):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        found = near_duplicates(docs(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 4, 85)


def test_the_rest_in_blocks_against_all_pairs(spark, monkeypatch):
    """The last comparisons alone, and shingles of many nodes in blocks of few."""
    rows = corpus(5)
    base = [f"w{i}" for i in range(40)]
    rows += [(1000 + k, " ".join([*base[:k], f"x{k}", f"y{k}", *base[k:]]), "en", "s", 1) for k in range(40)]
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    for block in (1, 7):
        monkeypatch.setattr(ngram_join, "REST", block)
        monkeypatch.setattr(ngram_join, "FEW", 1)
        found = near_duplicates(docs(spark, rows), 2, 70).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 2, 70)


def test_a_shingle_of_thousands_of_unlinked_documents(spark):
    """It is never among the rare ones of a set, so it brings no candidates."""
    rows = [(i, f"all rights reserved here {' '.join(f'{c}{i}' for c in 'abcdefgh')}", "en", "s", 1) for i in range(4000)]
    rows += [(5000 + i, "all rights reserved here", "en", "s", 1) for i in range(30)]
    found = near_duplicates(docs(spark, rows), 4, 85).collect()
    assert all(r.component_id == min(r.doc_id, 5000) and r.n_links == 0 for r in found)


def test_odd_rows(spark):
    frame = docs(spark)
    rows = [tuple(r) for r in frame.collect()]
    found = near_duplicates(frame, 4, 85).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 4, 85)


def test_rows_that_stay(spark):
    rows = corpus(5)
    parts = {doc: component for doc, _, component in brute(rows, 5, 80)}
    stay = without_near_duplicates(docs(spark, rows))
    assert stay.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(doc for doc, component in parts.items() if doc == component)


def test_no_rows_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert without_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert without_near_duplicates(clashing(spark)).columns == clashing(spark).columns


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_suffix_bound_is_a_bound(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert suffix_bound(x, y) >= len(a & b)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 4000), max_size=900), st.sets(st.integers(0, 4000)))
def test_parities_differ_in_no_more_than_the_sets(a, b):
    x, y = (parity(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert apart(x, y) == apart(y, x) <= len(a ^ b) and apart(x, x) == 0


def test_overlap_needed_is_exact():
    for a in range(1, 30):
        for b in range(1, 30):
            for i in range(min(a, b) + 1):
                assert (100 * i >= 85 * (a + b - i)) == (i >= overlap_needed(a, b, 85))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(1000, 1100)] + [(7, 7), (9, 8)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100} and {found[i] for i in range(1000, 1100)} == {500} and found[9] == 8
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_comparisons_by_chance_grow_with_the_rows(spark):
    """A shingle of many nodes in as many components brings a few pairs a node, not all of them."""
    join = ngram_join.NgramJoin(docs(spark), 4, 85)
    for n in (300, 600):
        split = spark.range(n).selectExpr("1L as token", "id as node", "100 as n", "0 as place", "id as root", f"{n}L as size")
        pairs = [tuple(r) for r in join._by_chance(split, 1).collect()]
        assert n < len(pairs) == len(set(pairs)) < 2 * ngram_join.CHANCES * n and all(a < b for a, b in pairs)
