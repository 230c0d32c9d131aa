"""SentencePiece encoding and decoding with N-best segmentations.

The vocabulary is read from a public model file. A text, with a space put before it, is a lattice of pieces; spaces stand for
the vocabulary's word mark. Forward Viterbi scores of all lattice nodes are exact heuristics for an A* search that starts at
the end and goes backward: it takes segmentations off its queue in order of their whole score, so the first n are the n best.

No piece goes on past a space or a line feed or from letters to other characters, which is checked when it is read. So a text
falls into chunks with a lattice of their own, and its best segmentations are made of those of its chunks. Only the n - 1 words that lose least by
their second best can differ from their best in any of the n best of the text; the search runs over them again for more.

The score of a piece is its log probability under a Zipf law over the order of the vocabulary (the model file gives ranks, no
probabilities). Pieces that the model bars with a score of -1e9 are not used. A character without a piece is spelled in bytes,
each at the score of the rarest piece less 10. Decoding gives the very text back, for every text.

Null and empty texts have no pieces, one segmentation (the empty one), and decode to the empty text; no rows give no rows. Ties between
segmentations fall to the one found first, which is the same every time.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Memory, batches_of, bounded_batches, held_for, text_bytes

NBEST = 3
#: Bytes that a worker remembers of words, of chunks, and of the segmentations that were searched for again.
WORDS, CHUNKS, DEEP = 384 << 20, 48 << 20, 32 << 20
_CHUNK = regex.compile(r" ?\p{L}+| ?[^\p{L} \n]+| |\n")

Segmentation = tuple[float, list[int]]
Entry = tuple[bytes, float, float]


_reach = itemgetter(0)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [0] * 256
        self.shown: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.shown.append(bytes([int(piece[1:-1], 16)]))
                continue
            plain = piece.replace("▁", " ")
            self.shown.append(b"" if model.is_control(i) or model.is_unknown(i) else plain.encode())
            if not (model.is_control(i) or model.is_unknown(i)) and model.get_score(i) > -1e8:
                self.ids[plain] = i
        if crossing := [p for p in self.ids if len(_CHUNK.findall(p)) != 1]:
            raise ValueError(f"pieces that go on where texts are cut: {crossing[:5]}")
        order = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))
        norm = math.log(sum(1 / (k + 1) for k in range(len(order))))
        self.score = {i: -math.log(k + 1) - norm for k, i in enumerate(order)}
        self.spelled = min(self.score.values()) - 10
        #: Pieces have their edge here, and what only begins a piece has nothing in it.
        self.edges: dict[str, tuple] = {p[:n]: () for p in self.ids for n in range(1, len(p))}
        self.edges |= {p: (self.score[i], (i,)) for p, i in self.ids.items()}
        self.known = Memory(WORDS)  # an Entry by what follows a space
        self.inner = Memory(CHUNKS)
        self.deep = Memory(DEEP)  # segmentations by word and number

    def ways(self, text: str, n: int) -> list[list[tuple[float, int, float, tuple[int, ...]]]]:
        """For each place in text, the n best edges that end there, best first: (best score up to the place by the edge, start, score, ids).

        The first of each is the forward Viterbi score. Of the edges into a place, no more than the n best can be in the n best.
        """
        get, size = self.edges.get, len(text)
        into: list[list] = [[] for _ in range(size + 1)]
        here = 0.0
        for start in range(size):
            if start:
                met = into[start]
                if len(met) > 1:
                    met.sort(key=_reach, reverse=True)
                    del met[n:]
                here = met[0][0]
            end = start + 1
            edge = get(text[start])
            if edge:
                into[end].append((here + edge[0], start, *edge))
            else:
                spelled = tuple(self.bytes[b] for b in text[start].encode("utf-8", "surrogatepass"))
                score = self.spelled * len(spelled)
                into[end].append((here + score, start, score, spelled))
            while edge is not None and end < size:
                end += 1
                edge = get(text[start:end])
                if edge:
                    into[end].append((here + edge[0], start, *edge))
        into[size].sort(key=_reach, reverse=True)
        del into[size][n:]
        return into

    def best(self, text: str, n: int) -> list[Segmentation]:
        """The n best segmentations of one lattice, best first."""
        ways = self.ways(text, n)
        found: list[Segmentation] = []
        queue = [(-ways[-1][0][0], 0, len(text), 0.0, None)]  # less the whole score, order of entry, place, score behind, path behind
        entered, push, pop = 0, heapq.heappush, heapq.heappop
        while queue:
            _, _, at, behind, path = pop(queue)
            if at:
                for reach, start, score, ids in ways[at]:
                    entered += 1
                    push(queue, (-reach - behind, entered, start, behind + score, (ids, path)))
                continue
            out: list[int] = []
            while path:
                out += path[0]
                path = path[1]
            found.append((behind, out))
            if len(found) == n:
                break
        return found

    def _searched(self, text: str) -> Entry:
        """The search for two, whose queue can be left out: with exact heuristics, it goes back along the best way, and the second best turns off
        it once, by the second edge into one of its places. Which one, their scores tell."""
        ways = self.ways(text, 2)
        at, behind, total, second, parts = len(text), 0.0, ways[-1][0][0], -math.inf, []
        while at:
            met = ways[at]
            if len(met) > 1 and met[1][0] + behind > second:
                second = met[1][0] + behind
            _, at, score, ids = met[0]
            behind += score
            parts.append(ids)
        best = [i for ids in reversed(parts) for i in ids]
        return np.array(best, "<u4").tobytes(), total, max(total - second, 0.0)

    def chunk(self, text: str) -> Entry:
        """Ids of the best segmentation of a chunk, its score, and what the second best loses (infinite where there is none)."""
        held, key = (self.known, text[1:]) if text[0] == " " else (self.inner, text)
        entry = held.get(key)
        if entry is None:
            entry = held.old.get(key) or self._searched(text)
            held.keep(key, entry, 2 * len(text) + len(entry[0]) + 200)
        return entry

    def word(self, word: str) -> Entry:
        """The same for a space and all that follows up to the next: the least that one of its chunks loses is what it loses."""
        entry = self.known.old.get(word)
        if entry is None:
            chunks = _CHUNK.findall(" " + word)
            if len(chunks) == 1:
                return self.chunk(chunks[0])
            ids, scores, losses = zip(*map(self.chunk, chunks), strict=True)
            entry = (b"".join(ids), math.fsum(scores), min(losses))
            if len(chunks) > 2 or "\n" in word:
                return entry
        return self.known.keep(word, entry, 2 * len(word) + len(entry[0]) + 200)

    def _deeper(self, word: str, n: int) -> list[Segmentation]:
        own = np.frombuffer((self.known.get(word) or self.word(word))[0], "<u4").tolist()
        made = self.best(" " + word, n)
        if made[0][1] != own:  # of equal scores, the one that the word is taken to have comes first
            made = [(made[0][0], own), *[m for m in made if m[1] != own]][:n]
        return self.deep.keep((word, n), made, 2 * len(word) + sum(8 * len(ids) + 200 for _, ids in made) + 200)

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: score, and ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return [(0.0, b"")]
        words = text.split(" ")
        entries = list(map(self.known.get, words))
        if None in entries:
            entries = [e or self.word(w) for e, w in zip(entries, words, strict=True)]
        ids, scores, losses = zip(*entries, strict=True)
        total = math.fsum(scores)
        out = [(total, b"".join(ids))]
        left = list(losses)
        ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]  # loss, (place, segmentation) of chunks not at their best
        others: dict[int, list[Segmentation]] = {}
        for _ in range(min(n - 1, len(left))):
            k = left.index(min(left))
            if left[k] == math.inf:
                break
            left[k] = math.inf
            others[k] = self.deep.get((words[k], n)) or self.deep.old.get((words[k], n)) or self._deeper(words[k], n)
            top = others[k][0][0]
            ways = heapq.nsmallest(n, [(w + max(top - s, 0.0), (*c, (k, i)) if i else c) for w, c in ways for i, (s, _) in enumerate(others[k])])
        for loss, changes in ways[1:]:
            changed = list(ids)
            for k, i in changes:
                changed[k] = np.asarray(others[k][i][1], "<u4").tobytes()
            out.append((total - loss, b"".join(changed)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids."""
        shown = self.shown
        return b"".join([shown[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    held = held_for("sentencepiece")
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.binary())])
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_best", pa.int32())]
    + [("best_score", pa.float64()), ("last_score", pa.float64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("ranks_crc32", pa.string())]
)


def _encoded(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        rows = (
            (doc, rank, score, ids)
            for b in batches
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for rank, (score, ids) in enumerate(encode(text.decode("utf-8", "replace"), n))
        )
        yield from batches_of(rows, _ENCODED)

    return run


def encode_documents(docs: DataFrame, model: str, nbest: int = NBEST) -> DataFrame:
    """doc_id, rank (0: best), score, ids (binary, little-endian unsigned 32-bit): up to nbest rows for each row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_encoded(model, nbest), "doc_id long, rank int, score double, ids binary")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with a column text, for its column ids."""

    @F.pandas_udf("string")
    def decoded(ids):
        decode = vocabulary(model).decode
        return ids.map(lambda x: None if x is None else decode(x).decode("utf-8", "replace"))

    return encoded.withColumn("text", decoded("ids"))


def _digests(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)

        def rows():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = words.encode(text.decode("utf-8", "replace"), n)
                    score, ids = found[0]
                    back = words.decode(ids)
                    sha = hashlib.sha256(back).hexdigest()
                    yield doc, len(ids) // 4, zlib.crc32(ids), len(found), round(score, 6), round(found[-1][0], 6), sha, back == text, ",".join([str(zlib.crc32(x)) for _, x in found])

        yield from batches_of(rows(), _DIGEST)

    return run


def segment_digests(docs: DataFrame, model: str, nbest: int = NBEST) -> DataFrame:
    """A row for each row of docs: what its n best segmentations are, in short, and whether the best decodes to its text.

    ranks_crc32 has the CRC-32 of the ids of each of them, the best first, comma-joined.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    ddl = "doc_id long, n_tokens long, ids_crc32 long, n_best int, best_score double, last_score double, decoded_sha256 string, round_trip boolean, ranks_crc32 string"
    return rows.mapInArrow(_digests(model, nbest), ddl)
