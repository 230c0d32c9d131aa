from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, SF, clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from weftline.llm.packing import WordEncoder, best_fit, pack, plan, reduce_dominated, token_pieces
from weftline.llm.registry import op4_best_fit_packing, word_tokenizer


def opened(made):
    return [[n for n, copies in content for _ in range(copies)] for times, content in made for _ in range(times)]


def one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        best = max(fits, key=sum, default=None)
        best.append(n) if best else bins.append([n])
    return bins


def fewest(lengths, capacity):
    """Exact, by branch and bound; for a few pieces only."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(order):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + order[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + order[k], *bins[i + 1 :]])
        go(k + 1, [*bins, order[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_bulk_best_fit_equals_one_by_one(lengths):
    assert len(opened(best_fit(Counter(lengths), 20))) == len(one_by_one(lengths, 20))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    fixed, left = reduce_dominated(Counter(lengths), 20)
    rest = [n for n, c in left.items() for _ in range(c)]
    assert Counter(n for b in opened(fixed) for n in b) + Counter(rest) == Counter(lengths)
    assert all(sum(b) <= 20 for b in opened(fixed))
    assert len(opened(fixed)) + fewest(rest, 20) == fewest(lengths, 20)


def test_reduction_alone_solves_pairs():
    fixed, left = reduce_dominated(Counter({12: 5, 8: 5, 11: 3, 7: 1}), 20)
    assert not [n for n in left if n > 10] and len(opened(fixed)) >= 8


def test_plan_is_close_to_the_volume_bound():
    rng = random.Random(1)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000)]
    assert len(opened(plan(Counter(lengths), 2048))) <= 1.01 * -(-sum(lengths) // 2048)


def check_whole(rows, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.ids_crc32 if r.doc_id is None else 0), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_doc, by_seq


@pytest.mark.parametrize("capacity", [16, 2048])
def test_odd_rows(spark, capacity):
    made = pack(token_pieces(docs(spark), word_tokenizer(), capacity), capacity).collect()
    by_doc, _ = check_whole(made, capacity)
    assert [r.length for r in by_doc[3, 0]] == [r.length for r in by_doc[4, 0]] == [1]
    long = sorted(by_doc[7, 0], key=lambda r: r.piece)
    assert sum(r.length for r in long) == 40001 and all(r.length == capacity for r in long[:-1])
    assert [r.start for r in long] == [capacity * k for k in range(len(long))]


def test_whole_table_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_tokenizer())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = op4_best_fit_packing(spark, SF).collect()
    by_doc, by_seq = check_whole(made, 2048)
    encoded = whole.encode_batch(list(texts.values()), add_special_tokens=False)
    for doc, e in zip(texts, encoded, strict=True):
        ids = np.asarray([*e.ids, 0], "<u4").tobytes()
        for r in by_doc[doc, 0]:
            assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert len(by_seq) <= 1.01 * -(-sum(r.length for r in made) // 2048)


def test_encoder_on_awkward_text():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(word_tokenizer()), WordEncoder(word_tokenizer())
    for text in ["It's, we'll. a...b,,c", "ÉTÉ İstanbul Straße ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "x\x1cy z w", "é café ﬁ ½ 12,345.6", "", " \n", "日本語。 한국어 🙂", "ǅ ŉ ſ"]:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_no_rows_and_clashing_columns(spark):
    assert pack(token_pieces(spark.createDataFrame([], DOCS), word_tokenizer())).count() == 0
    assert pack(token_pieces(clashing(spark), word_tokenizer())).count() == 6
    names = ["_row", "_slice", "_rank", "_row0", "_RANK1", "n", "row", "sequence_id", "offset"]
    pieces = spark.createDataFrame([(1 + i % 7, *[i] * len(names)) for i in range(50)], "length long, " + ", ".join(f"`{c}` long" for c in names))
    made = pack(pieces, 16)
    assert made.columns == ["length", *names[:-2], "sequence_id", "offset"]
    rows = made.collect()
    assert len(rows) == 50 and all(r.length == 1 + r.n % 7 and r._slice == r.n for r in rows)
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 16


def test_marks_behind_a_word_do_not_cost_a_whole_encoding(monkeypatch):
    from weftline.llm.packing import WordEncoder
    from weftline.llm.registry import word_tokenizer

    words = "erbleon.&&& reshsh,%%% thon##* \u00c9quetionpa, plain 12%".encode().split()
    made = WordEncoder(word_tokenizer())
    want = [made._whole(w.decode()) for w in words]
    seen = []
    whole = made._whole
    monkeypatch.setattr(made, "_whole", lambda text: seen.append(text) or whole(text))
    assert [made.encode(w) for w in words] == want
    assert not any(x[:1].isalpha() for x in seen)
