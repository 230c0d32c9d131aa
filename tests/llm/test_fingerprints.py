from __future__ import annotations

import hashlib

import numpy as np
from helpers import DOCS, SF, TINY, clashing, docs, texts
from weftline.llm.fingerprints import _rolled, anchors, fingerprint_documents, likeness, read, sketch, written
from weftline.llm.registry import op8_fingerprints


def test_anchors_are_closed_syncmers():
    text = open(__file__, "rb").read()[:2000]
    _, at = anchors(text, 24, 8)
    inner = _rolled(np.frombuffer(text, np.uint8).astype(np.uint64), 8).tolist()
    want = [i for i in range(len(text) - 23) if min(inner[i : i + 17]) in (inner[i], inner[i + 16])]
    assert at.tolist() == want


def test_anchors_depend_on_their_own_bytes_alone():
    body = ("some words of a passage that moves about, long enough to hold a good many anchors " * 3).encode()
    plain, moved = anchors(body), anchors(b"#" * 37 + body + b"!!!")
    inside = {(h, a - 37) for h, a in zip(*map(list, moved)) if 37 <= a <= 37 + len(body) - 24}
    assert inside == set(zip(*map(list, plain)))


def test_sketch_is_the_smallest_of_all_anchors():
    text = " ".join(str(i * i) for i in range(6000)).encode()
    hashes, at = anchors(text)
    chosen, first, n = sketch(text)
    assert chosen.tolist() == sorted(set(hashes.tolist()))[:64] and n == len(hashes)
    assert all(at[hashes == h].min() == p for h, p in zip(chosen, first))
    assert likeness(read(written(chosen, first)), (chosen, first)) == 1.0


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r.doc_id: r for r in op8_fingerprints(spark, SF).collect()}
    assert len(found) == len(rows)
    marks, near = {}, []
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        r, n = found[doc], len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1.0) or text != after
        near.append((r.near_edited, r.near_next))
    assert len(set(marks.values())) == len(marks)
    edited, following = np.array(near).T
    assert np.median(edited) > 0.4 and np.median(following) < 0.1


def plain_likeness(x: bytes, y: bytes, size=None):
    """By sets and a quadratic longest rising subsequence, from all anchors of both texts."""
    marks = []
    for text in (x, y):
        first = {}
        for h, at in zip(*(v.tolist() for v in anchors(text))):
            first.setdefault(h, at)
        marks.append(dict(sorted(first.items())[:size]))
    a, b = marks
    if not a and not b:
        return 1.0
    union = sorted(a.keys() | b.keys())[:size]
    shared = [h for h in union if h in a and h in b]
    if not shared:
        return 0.0
    place = [b[h] for h in sorted(a.keys() & b.keys(), key=a.get)]
    best = []
    for i, v in enumerate(place):
        best.append(1 + max((best[j] for j in range(i) if place[j] < v), default=0))
    return len(shared) / len(union) * max(best) / len(place)


def test_likeness_of_the_whole_table(spark):
    """The sketch's and that of all anchors, each against its plain form; and how far they are apart."""
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{TINY}/documents.parquet").collect())
    frame = spark.read.parquet(f"{TINY}/documents.parquet")
    told = {size: {r.doc_id: r for r in fingerprint_documents(frame, size).collect()} for size in (64, None)}
    apart = []
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        m = len(text) // 4
        edited = (text[: len(text) - m] + after[:m] if m else text).encode()
        for size, found in told.items():
            near = [plain_likeness(text.encode(), other, size) for other in (edited, after.encode())]
            assert [found[doc].near_edited, found[doc].near_next] == near
        assert len(read(told[None][doc].fingerprint)[0]) == len(set(anchors(text.encode())[0].tolist()))
        apart.append(told[64][doc].near_edited - told[None][doc].near_edited)
    assert np.abs(apart).mean() < 0.04 and np.sqrt(np.mean(np.square(apart))) < 0.07


def test_likeness_estimates_all_anchors():
    rng = np.random.default_rng(1)
    a = rng.integers(97, 123, 20000).astype(np.uint8).tobytes()
    for share in (0.9, 0.75, 0.5):
        b = a[: int(share * 20000)] + rng.integers(97, 123, 20000 - int(share * 20000)).astype(np.uint8).tobytes()
        x, y = (set(anchors(t)[0].tolist()) for t in (a, b))
        assert abs(likeness(sketch(a)[:2], sketch(b)[:2]) - len(x & y) / len(x | y)) < 0.2


def test_odd_rows(spark):
    found = fingerprint_documents(docs(spark)).collect()
    assert len(found) == 11 and sum(r.doc_id is None for r in found) == 2
    empty = [r for r in found if r.doc_id in (3, 4)]
    assert {r.fingerprint for r in empty} == {""} and all(r.n_chars == 0 for r in empty)
    (only,) = fingerprint_documents(texts(spark, "abcdefgh")).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_no_rows_and_clashing_columns(spark):
    assert fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert fingerprint_documents(clashing(spark)).count() == 6
