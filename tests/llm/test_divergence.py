from __future__ import annotations

import re
from collections import Counter

import duckdb
from helpers import DOCS, SF, clashing, docs
from weftline.llm.divergence import ORACLE_SQL, source_divergence, term_counts
from weftline.llm.registry import op13_source_divergence


def plain(rows, least=3, most=200):
    """Term by term, pair by pair."""
    words, seen, groups = {}, {}, set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        words.setdefault((lang, source), Counter()).update(terms)
        seen.setdefault(lang, Counter()).update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        own = {s: {t: words[lang, s][t] for t in kept} for x, s in groups if x == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        share = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in own.items()}
        for s in own.keys() - {None}:
            items = [("pair", o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in own if o not in (None, s)]
            items += [("term", t, f(share[s][t], share[None][t])) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            for part in ("pair", "term"):
                ranked = sorted((x for x in items if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (_, i, v) in enumerate(ranked, 1) if part == "pair" or r <= most]
    return sorted(out)


def found(frame, **options):
    return sorted(map(tuple, source_divergence(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, op13_source_divergence(spark, SF).collect()))
    assert got == sorted(con.sql(ORACLE_SQL).fetchall()) and len(got) > 10_000


def test_odd_rows_against_brute_force(spark):
    frame = docs(spark)
    rows = [tuple(r) for r in frame.collect()]
    assert found(frame) == plain(rows)
    assert found(frame, least_docs=1, most_terms=2) == plain(rows, 1, 2)
    assert found(frame, least_docs=99) == plain(rows, 99)
    assert all(v == 0 for *_, v, _ in found(frame, least_docs=99))  # no kept terms: pairs without a difference


def test_ties_are_ranked_by_bytes(spark):
    rows = [(i, t, "x", s, 0) for i, (t, s) in enumerate([("zz é É", "a"), ("zz é É", "b"), ("zz é É", "c"), ("q", "c"), ("", "ü"), ("", "z")] * 3)]
    assert found(docs(spark, rows)) == plain(rows)


def test_a_term_counts_once_a_document(spark):
    frame = docs(spark, [(1, "one one one ONE", "x", "a", 0), (2, "one two", "x", "a", 0), (3, "two", "x", "b", 0), (3, "two", "x", "b", 0)])
    assert {r.term for r in term_counts(frame).collect()} == {"two"}


def test_clashing_columns_and_no_rows(spark):
    frame = clashing(spark).selectExpr("*", "'x' AS lang", "'s' AS source", "1 AS na", "2 AS nb", "3 AS many", "4 AS docs")
    assert source_divergence(frame).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_partitions_do_not_matter(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    rows = [tuple(r) for r in frame.collect()]
    again = docs(spark, rows)
    assert found(again.repartition(7)) == found(again.coalesce(1)) == plain(rows)
