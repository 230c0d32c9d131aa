from __future__ import annotations

import random
import re
import time
from itertools import product

from helpers import DOCS, SF, clashing, docs, texts
from weftline.llm.licenses import BASE, GRADES, NOTICES, UNKNOWN, evaluate, leading, parse, scan, scan_licenses
from weftline.llm.registry import op1_license_scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, BASE[p]) for p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_whole_table_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = op1_license_scan(spark, SF).collect()
    assert len(found) == len(rows) and any(r.n_base for r in found)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(rows[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def descend(tokens):
    """(tree, tokens left) of an expression by recursive descent, or None."""

    def level(ops, below):
        def read(left):
            got = below(left)
            while got and got[1] and got[1][0] in ops:
                right = below(got[1][1:])
                if not right:
                    return None
                got = ((got[1][0], got[0], right[0]), right[1])
            return got

        return read

    def operand(left):
        if not left or left[0] in (")", "and", "or", "with"):
            return None
        if left[0] != "(":
            return left[0], left[1:]
        got = either(left[1:])
        return (got[0], got[1][1:]) if got and got[1] and got[1][0] == ")" else None

    either = level(("or",), level(("and",), level(("with",), operand)))
    return either(tokens)


def named(tree):
    return [tree] if isinstance(tree, str) else named(tree[1]) + ([] if tree[0] == "with" else named(tree[2]))


def burden(tree):
    if isinstance(tree, str):
        return GRADES.get(re.match(r"[^-.0-9+]*", tree)[0], UNKNOWN)
    a, b = burden(tree[1]), burden(tree[2])
    return max(a - 1, 0) if tree[0] == "with" else min(a, b) if tree[0] == "or" else max(a, b)


def plain_scan(text):
    """labels, expressions, obligation and score, by looking at each word, and at each prefix of what follows a tag."""
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    phrases = {**BASE, **NOTICES}
    hits = sorted((i, -len(p.split()), p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    trees = []
    for line in small.split("\n"):
        for piece in line.split("spdx-license-identifier:")[1:] if "spdx-license-identifier:" in line else []:
            tokens = re.findall(r"[()]|[a-z0-9][a-z0-9.+:-]*", piece)
            clean = [t.rstrip(".:") for t in tokens]
            whole = [n for n in range(1, len(tokens) + 1) if (got := descend(clean[:n])) and not got[1]]
            if whole:
                trees.append((" ".join(tokens[: whole[-1]]), descend(clean[: whole[-1]])[0]))
    tags = len(trees)
    outer, reach = [], 0
    for i, n, p in hits:
        if i >= reach:
            outer.append((i, i - n, phrases[p]))
            reach = i - n
    chains = [[outer[0][2]]] if outer else []
    for (_, end, _), (start, _, label) in zip(outer, outer[1:]):
        link = [w for w in words[end:start] if w != "the"]
        if start - end <= 3 and len(link) == 1 and link[0] in ("and", "or", "with"):
            chains[-1] += [link[0], label]
        else:
            chains.append([label])
    trees += [(" ".join(c), descend(c)[0]) for c in chains if len(c) > 1]
    labels = {phrases[p] for *_, p in hits} | {x for _, t in trees for x in named(t)}
    score = 1.0 if tags else 0.9 if any(p in BASE for *_, p in hits) else 0.6 if hits else 0.0
    grades = [burden(t) for _, t in trees] or [burden(x) for x in labels]
    return ",".join(sorted(labels)), "; ".join(w for w, _ in trees), max(grades, default=None), score


def test_labels_of_the_whole_table_against_plain_reading(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = op1_license_scan(spark, SF).collect()
    assert any("," in r.labels for r in found)
    for r in found:
        assert (r.labels, r.expressions, r.obligation, r.score) == plain_scan(rows[r.doc_id])


def test_made_up_texts_against_plain_reading():
    rng = random.Random(7)
    bits = ["SPDX-License-Identifier:", "MIT", "gpl-2.0+", "OR", "and", "WITH", "(", ")", "\n", "the", "MIT License", "Apache License", "cc by", "cc by sa", "word", "public domain"]
    for _ in range(3000):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        made = scan(text.encode())
        assert (made[5], made[6], made[7], made[8]) == plain_scan(text), text


def test_many_tags_on_a_line_are_read_once():
    began = time.time()
    made = scan(b"SPDX-License-Identifier: MIT " * 20_000)
    assert made[5] == "mit" and made[6].count(";") == 19_999 and time.time() - began < 10


def test_awkward_texts(spark):
    values = [None, "", "MIT License mit license MIT-LICENSE", "cc by cc by-sa", "É mit\x00license", "apache" * 9, "gnu general public license mit license", "x " * 30000 + "cc_by"]
    for r in scan_licenses(texts(spark, *values)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(values[r.doc_id])


def test_shunting_yard():
    assert parse("mit or apache and bsd with classpath".split()) == ["mit", "apache", "bsd", "classpath", "with", "and", "or"]
    assert parse("( mit or apache ) and gpl".split()) == ["mit", "apache", "or", "gpl", "and"]
    for wrong in ("mit or", "or mit", "( mit", "mit )", "mit apache", "( )", ""):
        assert parse(wrong.split()) is None
    assert evaluate(parse("gpl-2.0 or mit".split())) == (1, ["gpl-2.0", "mit"])
    assert evaluate(parse("gpl-2.0 and mit".split()))[0] == 3
    assert evaluate(parse("gpl-2.0 with classpath-exception-2.0".split())) == (2, ["gpl-2.0"])


def test_tags_and_joined_notices():
    n, base, first, last, base_labels, labels, expressions, grade, score = scan(b"// SPDX-License-Identifier: MIT OR (GPL-2.0+ AND BSD-3-Clause) */ code")
    assert labels == "bsd-3-clause,gpl-2.0+,mit" and grade == 1 and score == 1.0 and expressions.startswith("mit or (")
    joined = scan(b"Use it under the MIT License or the Apache License, as you like.")
    assert joined[5] == "apache,mit" and joined[6] == "mit or apache" and joined[7] == 1
    assert scan(b"SPDX-License-Identifier: or or")[5:7] == ("", "")


def test_what_follows_a_tag_does_not_count_however_long():
    for written in ("mit", "gpl-2.0-only or mit", "mit and (isc or bsd-3-clause)"):
        short = scan(f"SPDX-License-Identifier: {written}".encode())
        for n in (1, 39, 41, 42, 500, 50_000):
            for more in ("word " * n, "( " * n, "or ( mit and " * n, ") " * n):
                assert scan(f"SPDX-License-Identifier: {written} {more}".encode())[5:] == short[5:]
    long = " or ".join(["mit"] * 300)
    assert scan(f"SPDX-License-Identifier: {long} and so on, {'x ' * 99}".encode())[6] == f"{long} and so"


def test_longest_expression_against_all_prefixes():
    for n in range(7):
        for tokens in product(("mit", "or", "(", ")"), repeat=n):
            assert leading(iter(tokens)) == list(next((tokens[:k] for k in range(n, 0, -1) if parse(list(tokens[:k]))), ()))


def test_no_rows_and_clashing_columns(spark):
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    assert scan_licenses(clashing(spark)).count() == 6 and scan_licenses(docs(spark)).count() == 11
