from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import DOCS, SF, TINY, clashing, docs
from weftline.llm.registry import piece_model
from weftline.llm.sentencepiece_nbest import Vocabulary, decode_documents, encode_documents, segment_digests


@pytest.fixture(scope="module")
def words():
    return Vocabulary(piece_model())


def every(words, text):
    """Scores of all segmentations of a short text, best first, from the pieces alone."""
    ways = [[] for _ in range(len(text) + 1)]
    ways[0] = [(0.0, [])]
    for end in range(1, len(text) + 1):
        for start in range(end):
            part = text[start:end]
            if part in words.ids:
                ways[end] += [(s + words.score[words.ids[part]], [*ids, words.ids[part]]) for s, ids in ways[start]]
            elif end == start + 1:
                spelled = [words.bytes[b] for b in part.encode()]
                ways[end] += [(s + words.spelled * len(spelled), [*ids, *spelled]) for s, ids in ways[start]]
    return sorted(ways[-1], key=lambda w: -w[0])


def test_search_against_all_segmentations(words):
    for text in (" the", " nation", " été", "!!", " 日本x", " 🙂a", "\n", " aaaaaaa", " walls, and"):
        want = every(words, text)
        for n in (1, 2, 5):
            found = words.best(text, n)
            assert [round(s, 9) for s, _ in found] == [round(s, 9) for s, _ in want[:n]]
            assert len({tuple(i) for _, i in found}) == len(found)


def test_the_search_for_two_is_the_search(words):
    for text in [" the", " nation", "!!", " 日本x", " aaaaaaa", "\n", " thontiontion", " ble", " x", "zqj", " antidisestablishmentarianism", " 🙂a"]:
        first, *second = words.best(text, 2)
        ids, score, loss = words._searched(text)
        assert abs(score - first[0]) < 1e-9 and (np.frombuffer(ids, "<u4").tolist() == first[1] or second and abs(second[0][0] - first[0]) < 1e-9)
        assert abs(loss - (first[0] - second[0][0])) < 1e-9 if second else loss == np.inf


def test_texts_of_many_chunks_against_all_segmentations(words):
    for text in ("a bc, de", "it  is", "x\ny z", "of in to"):
        want = every(words, " " + text)
        found = words.encode(text, 4)
        assert [round(s, 9) for s, _ in found] == [round(s, 9) for s, _ in want[:4]]


def test_round_trips(spark, words):
    odd = ["", " ", "  a ", "▁ under ▁", "tab\tand\r\n\n", "日本語 한국어 🙂", "\x00\x1f 　", "<s> </s> <0x0A>", "²½ 3.14", "é" * 3000]
    odd += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    for text in odd:
        for _, ids in words.encode(text, 3):
            assert words.decode(ids).decode() == text


def test_documents(spark, words):
    frame = docs(spark)
    encoded = encode_documents(frame, piece_model(), 3)
    back = decode_documents(encoded, piece_model()).collect()
    texts = {}
    for r in frame.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    assert all(r.text in texts[r.doc_id] for r in back)
    digests = segment_digests(frame, piece_model()).collect()
    assert len(digests) == 11 and all(r.round_trip and r.best_score >= r.last_score for r in digests)
    assert {r.n_tokens for r in digests if r.doc_id in (3, 4)} == {0}
    told = sorted(",".join(str(zlib.crc32(ids)) for _, ids in words.encode(r.text or "", 3)) for r in frame.collect())
    assert sorted(r.ranks_crc32 for r in digests) == told
    best = {r.doc_id: np.frombuffer(r.ids, "<u4").size for r in back if r.rank == 0 and r.doc_id in (1, 5, 7)}
    assert all(best[r.doc_id] == r.n_tokens for r in digests if r.doc_id in best)


def test_no_rows_and_clashing_columns(spark):
    assert segment_digests(spark.createDataFrame([], DOCS), piece_model()).count() == 0
    assert segment_digests(clashing(spark), piece_model()).count() == 6


def test_whole_texts_have_distinct_ranks_that_decode(spark, words):
    """Every text of a table, each of its segmentations: in order, different, and the text again."""
    for r in spark.read.parquet(f"{TINY}/documents.parquet").collect():
        found = words.encode(r.text or "", 3)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({ids for _, ids in found}) == len(found)
        for score, ids in found:
            assert words.decode(ids).decode() == (r.text or "")
            known = [words.score.get(i) for i in np.frombuffer(ids, "<u4").tolist()]
            assert abs(sum(words.spelled if s is None else s for s in known) - score) < 1e-6 * max(1, len(known))
