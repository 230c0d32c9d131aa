from __future__ import annotations

import math

import duckdb
import numpy as np
from helpers import SF
from weftline.llm.quantised import ORACLE_SQL, coded, fit_book, near_vectors, unit
from weftline.llm.registry import op11_embedding_near_dedup

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, least=0.98):
    """All pairs, and components by flooding."""
    rows = [tuple(r) for r in rows]
    good = [r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    units = [unit(np.array([r[1]]))[0] if g else None for r, g in zip(rows, good)]
    near = [[] for _ in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            if good[i] and good[j] and a[2] == rows[j][2] and len(a[1]) == len(rows[j][1]) and float(units[i] @ units[j]) >= least:
                near[i].append(j)
                near[j].append(i)
    out, place = [], {}
    for i in range(len(rows)):
        if i not in place:
            seen, stack = {i}, [i]
            while stack:
                for j in near[stack.pop()]:
                    if j not in seen:
                        seen.add(j)
                        stack.append(j)
            least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            place |= dict.fromkeys(seen, least_id)
        out.append((rows[i][0], len(near[i]), place[i], rows[i][0] == place[i]))
    return sorted(out, key=str)


def found(frame, **options):
    return sorted((tuple(r)[:4] for r in near_vectors(frame, **options).collect()), key=str)


def clustered(seed, groups, each, alone, dim=16, spread=0.02):
    rng = np.random.default_rng(seed)
    rows = [c + rng.normal(size=dim) * spread * np.linalg.norm(c) for c in rng.normal(size=(groups, dim)) for _ in range(each)]
    rows += list(rng.normal(size=(alone, dim)))
    order = rng.permutation(len(rows))
    return [(i, (rows[k] * rng.uniform(0.1, 9)).tolist(), int(rng.integers(3)) if i % 3 else 0) for i, k in enumerate(order)]


def test_probes_and_lookups_rule_out_no_near_row():
    rng = np.random.default_rng(2)
    rows = unit(rng.normal(size=(600, 24)))
    book = fit_book(rows[:300], 16)
    radius = 0.2
    moved = rng.normal(size=rows.shape)
    moved -= (moved * rows).sum(1)[:, None] * rows
    others = unit(rows + 0.199 * unit(moved))  # each just within the radius
    a, _, _, probes_a = coded(rows, book, radius)
    b, codes, least, probes_b = coded(others, book, radius)
    crossed = 0
    for i in range(len(rows)):
        assert np.linalg.norm(rows[i] - others[i]) <= radius
        crossed += a[i] != b[i]
        assert a[i] == b[i] or (b[i] in probes_a[i] if a[i] < b[i] else a[i] in probes_b[i])
        stands = book.centres[b[i]].copy()
        for k, words in enumerate(book.codewords):
            stands[book.edges[k] : book.edges[k + 1]] += words[codes[i, k]]
        assert rows[i] @ stands >= least[i]
    assert crossed > 20
    lists = coded(rows, fit_book(rows[:4], 4), radius)[3]
    assert sum(map(len, lists)) < 600 * 3 / 2  # and some lists are left out


def test_clusters_against_brute_force(spark):
    rows = clustered(1, 12, 14, 250)
    frame = spark.createDataFrame(rows, VECTORS)
    want = plain(rows)
    assert sum(r[1] > 0 for r in want) > 80
    for options in ({}, {"list_rows": 16}, {"list_rows": 8, "block": 5, "chunk": 7}):
        assert found(frame, **options) == want, options


def test_one_group_holds_a_third(spark):
    rows = clustered(7, 1, 200, 400, spread=0.01)
    rows = [(i, v, 1) for i, v, _ in rows]
    assert found(spark.createDataFrame(rows, VECTORS).repartition(6), list_rows=32, block=24, chunk=40) == plain(rows)


def test_other_thresholds(spark):
    rows = clustered(3, 8, 10, 150, dim=7, spread=0.1)
    frame = spark.createDataFrame(rows, VECTORS)
    for least in (0.9, 0.995):
        assert found(frame, least_cosine=least, list_rows=16) == plain(rows, least)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
        (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1e300, -0.0], 1), (13, [1e-300, 0.0], 1), (14, [-1.0, 0.0], 1), (None, [3.0, 0.0], 1),
        (None, [1.0, 1.0], 5), (15, [0.0, 7.0], 1), (15, [0.0, 7.0], 1), (16, [1.0, 0.0], 1), (16, [0.0, 1.0], 9),
    ]
    frame = spark.createDataFrame(rows, VECTORS)
    got = near_vectors(frame).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == plain(rows)
    assert [r.n_copies for r in got if r.vec_id == 15] == [2, 2] and {r.n_copies for r in got if r.vec_id == 1} == {2}
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id in (4, 5, 6, 7, 8, 9, 10, 11))


def test_clashing_columns_and_no_rows(spark):
    rows = clustered(4, 3, 5, 10)
    names = ["node", "weight", "level", "list", "dim", "vec", "links", "m1", "block", "chunk", "own", "role"]
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows], VECTORS + ", " + ", ".join(f"{n} int" for n in names))
    assert found(wide) == plain(rows)
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None, None)], VECTORS)).count() == 1


def test_whole_table_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = "vec_id, n_links, component_id, kept, n_copies"
    got = sorted(map(tuple, op11_embedding_near_dedup(spark, SF).selectExpr(*columns.split(", ")).collect()))
    assert got == sorted(con.sql(f"SELECT {columns} FROM ({ORACLE_SQL})").fetchall())


def test_sql_tells_links(spark):
    rows = clustered(5, 4, 6, 20)
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLE_SQL})").fetchall(), key=str) == plain(rows)
