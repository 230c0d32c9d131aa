"""Licence scans: one Aho-Corasick pass finds identifier tags and notice phrases; a shunting-yard parser reads expressions.

A text is lower-cased (A-Z) and cut into words; the words, joined by single spaces, are the string that the automaton reads,
so a phrase is found wherever its words stand consecutively, overlaps included. Notices joined by and, or, with in the
text, and what stands after an SPDX tag, are expressions: they are parsed to postfix order (with binds tightest, then and,
then or) and evaluated to the least that a user must comply with: ``or`` takes the lighter side, ``and`` the heavier one, and
``with`` an exception lightens by one grade. A null or empty text has no words, no labels and score 0; no rows give
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches_of, bounded_batches, text_bytes

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices and the labels that this method adds.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
RAW_TAG = b"spdx-license-identifier:"
#: Grades of obligation, by the first part of a label: 0 none, 1 notice, 2 file copyleft, 3 copyleft, 4 reserved.
GRADES = {"public": 0, "cc0": 0, "unlicense": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "cc": 1, "mpl": 2, "epl": 2, "lgpl": 2, "gfdl": 3, "gpl": 3, "agpl": 3, "all": 4}
UNKNOWN = 4
BINDS = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+:-]*")
_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [(c, pa.string()) for c in ("base_labels", "labels", "expressions")]
    + [("obligation", pa.int32()), ("score", pa.float64())]
)
_OUT_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, obligation int, score double"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def parse(tokens: list[str]) -> list[str] | None:
    """Postfix order, by two stacks; None where the tokens are no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[int, list[str]]:
    """The grade of obligation, and the licences named (exceptions aren't licences)."""
    stack: list[tuple[int, list[str]]] = []
    for token in postfix:
        if token not in BINDS:
            grade = GRADES.get(re.split(r"[-.0-9+]", token)[0], UNKNOWN)
            stack.append((grade, [token]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        stack.append((max(a - 1, 0), left) if token == "with" else (min(a, b) if token == "or" else max(a, b), left + right))
    return stack[0]


def leading(tokens: Iterator[str]) -> list[str]:
    """The longest run of tokens, from the first on, that is an expression; what stops every longer one ends the reading."""
    held: list[str] = []
    whole, depth, operand_next = 0, 0, True
    for token in tokens:
        name = token.rstrip(".:")
        if (name == ")" or name in BINDS) == operand_next or name == ")" and not depth:
            break
        depth += (name == "(") - (name == ")")
        operand_next = name == "(" or name in BINDS
        held.append(token)
        if not operand_next and not depth:
            whole = len(held)
    return held[:whole]


def tagged(text: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Expressions after SPDX tags, each to the end of its line or to the next tag: as written, grade, licences. text: lower-cased."""
    at = text.find(RAW_TAG)
    while at >= 0:
        at += len(RAW_TAG)
        line, tag = text.find(b"\n", at), text.find(RAW_TAG, at)
        ends = [end for end in (line, tag, len(text)) if end >= 0]
        tokens = (m[0].decode() for m in _TOKEN.finditer(text, at, min(ends)))
        if written := leading(tokens):  # what follows an expression on its line is no part of it
            yield (" ".join(written), *evaluate(parse([t.rstrip(".:") for t in written])))
        at = tag


_AUTOMATA: dict[tuple, object] = {}


def automaton(phrases: tuple[str, ...]):
    if phrases not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for phrase in phrases:
            made.add_word(f" {phrase} ", phrase)
        made.make_automaton()
        _AUTOMATA[phrases] = made
    return _AUTOMATA[phrases]


def joined_notices(words: list[bytes], hits: list[tuple[int, str]]) -> Iterator[tuple[str, int, list[str]]]:
    """Expressions made by notices that and, or, with join in the text. hits: (first word, phrase), without hits inside others."""
    chain: list[str] = []
    after = -1
    for at, phrase in [*hits, (1 << 60, "")]:
        gap = [w.decode("latin-1") for w in words[after:at]] if chain and at - after <= 3 else []
        link = [w for w in gap if w != "the"]
        if chain and len(link) == 1 and link[0] in BINDS:
            chain += [link[0], NOTICES.get(phrase) or BASE.get(phrase, "")]
        else:
            if len(chain) > 1 and (postfix := parse(chain)):
                yield (" ".join(chain), *evaluate(postfix))
            chain = [NOTICES.get(phrase) or BASE.get(phrase, "")] if phrase else []
        after = at + phrase.count(" ") + 1


def scan(text: bytes) -> tuple:
    """All columns of a text's row but doc_id."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    hits = []
    counted, place = 0, 0
    for end, phrase in automaton((*BASE, *NOTICES, TAG)).iter(line.decode("latin-1")):
        start = end - len(phrase) - 1  # of the space before it
        counted += line.count(b" ", place, start) if start >= place else -line.count(b" ", start, place)
        place = start
        hits.append((counted, phrase))
    base = [at for at, phrase in hits if phrase in BASE]
    base_labels = {BASE[p] for _, p in hits if p in BASE}
    notices = [(at, p) for at, p in hits if p in NOTICES]
    expressions = list(tagged(text.lower())) if any(p == TAG for _, p in hits) else []
    score = 1.0 if expressions else 0.9 if base else 0.6 if notices else 0.0
    if hits:
        whole = sorted((at, -len(p), p) for at, p in hits if p != TAG)
        outer, reach = [], -1
        for at, _, p in whole:
            if at >= reach:
                outer.append((at, p))
                reach = at + p.count(" ") + 1
        expressions += joined_notices(words, outer)
    labels = base_labels | {NOTICES[p] for _, p in notices} | {x for _, _, named in expressions for x in named}
    grades = [g for _, g, _ in expressions] or [evaluate([x])[0] for x in labels]
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)),
        "; ".join(e for e, _, _ in expressions), max(grades, default=None), score,
    )


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((doc, *scan(text)) for b in batches for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    yield from batches_of(rows, _OUT)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of docs; only doc_id and text are read."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_scan_all, _OUT_DDL)
