"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

Everything is a DataFrame expression; there is no Python on the way. A kind's pattern is run twice over a text that may hold
it: once for the matches and once to split the text between them, and the lengths of both, added up in order, give the places.
Patterns that begin with a run of characters are tried where such a run begins, or where the match before has ended, and nowhere inside it:
if a match can't begin there, it can't begin further on. Sums run in chunks, and what stands beside a match is cut from the text in an
encoding of fixed width. So the work is about linear in the text and its matches, however long runs are.

Kinds, in the order of their spans: email, ip, card, phone (the base kinds), then iban, ssn and secret. A match that its
validator refuses is dropped, and the text inside it is not tried again. The score of a span is the kind's own, plus what a
context word within 40 code points of it adds; a span counts from 0.5 on. Base kinds always do, ssn and secret only beside a
context word. A null or empty text has no spans; no rows give no rows. Columns besides text are kept or left unread, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let, running

WINDOW = 40
THRESHOLD = 0.5
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


@dataclass(frozen=True)
class Kind:
    """gate: a plain pattern without which the text can't hold a match. own: score without context; near: what context adds. run: the characters that it begins with, if a match takes all of them that follow each other."""

    name: str
    pattern: str
    gate: str
    own: float
    near: float
    context: str
    run: str = ""

    @property
    def tried(self) -> str:
        """The pattern with what keeps it from being tried inside a run."""
        return rf"(?:\G|(?<![{self.run}]))(?:{self.pattern})" if self.run else self.pattern


# Possessive quantifiers match what the greedy ones of the contract do, since no shorter run could match either; they keep
# the matcher from going back, and from recursing on long runs.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.2, "mail|contact|write", "A-Za-z0-9._%+-"),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, 0.3, "ip|host|server|address", "0-9"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.7, 0.3, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, 0.3, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", 0.7, 0.3, "iban|bank|account"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", 0.3, 0.5, "ssn|social|security"),
    Kind("secret", r"[A-Za-z0-9_]{32,}+", "[A-Za-z0-9_]{32}", 0.2, 0.6, "token|secret|password|api_key"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, the sum of all digits ends in 0."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a bank account number without spaces passes: its first four characters moved to the end, letters as 10 to 35, 1 modulo 97."""

    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    values = F.transform(F.split(moved, ""), lambda c: F.position(c, F.lit(DIGITS)).cast("int") - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97) == 1


def _valid(kind: str, match: Column, before: Column, after: Column) -> Column:
    """before, after: the characters beside the match, empty at the ends of the text."""
    n = F.length(_digits(match))
    alone = ~F.concat(before, after).rlike("[A-Za-z0-9]")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(alone & F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind in ("ssn", "secret"):
        return alone
    return F.lit(True)


def _wide(text: Column) -> Column:
    """The text in four bytes a code point, so that a part of it is found without reading what is before."""
    return F.encode(text, "UTF-32")


def _part(wide: Column, start: Column, n: Column) -> Column:
    return F.decode(F.substr(wide, (start * 4 + 1).cast("int"), (n * 4).cast("int")), "UTF-32")


def _of_kind(kind: Kind, text: Column, wide: Column) -> Column:
    """The spans of a kind; an expression on a text that isn't null."""
    found = F.regexp_extract_all(text, F.lit(kind.tried), F.lit(0))
    between = F.split(text, kind.tried, -1)
    pairs = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))  # the last has no match

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["b"]
        return start + F.coalesce(F.length(x["m"]), F.lit(0)), F.struct(x["m"].alias("m"), start.alias("start"))

    placed = running(pairs, F.lit(0), "struct<m:string,start:int>", step)

    def keep(x: Column) -> Column:
        before = F.when(x["start"] > 0, _part(wide, x["start"] - 1, F.lit(1))).otherwise("")
        return x["m"].isNotNull() & _valid(kind.name, x["m"], before, _part(wide, x["start"] + F.length(x["m"]), F.lit(1)))

    def scored(x: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        left = F.greatest(x["start"] - WINDOW, F.lit(0))
        window = F.concat(_part(wide, left, x["start"] - left), F.lit(" "), _part(wide, end, F.lit(WINDOW)))
        score = F.lit(kind.own) + F.when(F.lower(window).rlike(kind.context), F.lit(kind.near)).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].cast("long").alias("start"), end.cast("long").alias("end"), score.alias("score"))

    spans = F.filter(F.transform(F.filter(placed, keep), scored), lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.gate), spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def spans_of(text: Column) -> Column:
    """All spans of a text: array of (kind, start, end, score), by kind, then by start; code points, end exclusive."""
    filled = F.coalesce(text, F.lit(""))
    found = let(_wide(filled), lambda wide: F.concat(*[_of_kind(kind, filled, wide) for kind in KINDS]))
    return F.when(filled.rlike("|".join(kind.gate for kind in KINDS)), found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, top_score for each row of docs."""
    found = docs.select("doc_id", spans_of(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)), 2).alias("top_score"),
    )


def masked(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first to start names the place. Null stays null."""
    ordered = F.array_sort(F.transform(spans_of(text), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        told = F.when(s["start"] >= at, F.struct(at.alias("at"), s["start"].alias("until"), s["kind"].alias("kind"), (-s["back"]).alias("end")))
        return F.greatest(at, -s["back"]), told

    def put(wide: Column, gaps: Column) -> Column:
        shown = F.transform(gaps, lambda g: F.concat(_part(wide, g["at"], g["until"] - g["at"]), F.lit("["), F.upper(g["kind"]), F.lit("]")))
        end = F.array_max(F.transform(gaps, lambda g: g["end"]))
        return F.concat(F.array_join(shown, ""), _part(wide, end, F.length(text) - end))

    def whole(spans: Column) -> Column:
        gaps = F.filter(running(spans, F.lit(0).cast("long"), "struct<at:long,until:long,kind:string,end:long>", step), lambda g: g.isNotNull())
        return F.when(F.size(spans) > 0, let(_wide(text), lambda wide: let(gaps, lambda g: put(wide, g)))).otherwise(text)

    return let(ordered, whole)


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with texts masked and, where there is one, n_chars counted anew; rows and columns stay as they are."""
    out = docs.withColumn("text", masked(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _oracle_kind(kind: Kind) -> str:
    """The spans of one kind, for an engine without possessive quantifiers."""
    pattern = kind.pattern.replace("++", "+").replace("}+", "}")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    alone = "NOT regexp_matches(before || after, '[A-Za-z0-9]')"
    code = "replace(m, ' ', '')"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR cast(right(p, 3) AS INT) > 255)) = 0",
        "card": f"""CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
            CASE WHEN (length({digits}) - i) % 2 = 0 THEN cast(substr({digits}, i, 1) AS INT)
                 ELSE cast(substr({digits}, i, 1) AS INT) * 2 - CASE WHEN substr({digits}, i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0 ELSE false END""",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"""CASE WHEN {alone} AND length({code}) BETWEEN 15 AND 34 THEN list_reduce(list_transform(
            range(1, length({code}) + 1), lambda i: cast(strpos('{DIGITS}', substr(substr({code}, 5) || substr({code}, 1, 4), i, 1)) - 1 AS BIGINT)),
            lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97, 0::BIGINT) = 1 ELSE false END""",
        "ssn": alone,
        "secret": alone,
    }[kind.name]
    order = [k.name for k in KINDS].index(kind.name)
    return f"""
SELECT doc_id, {order} AS k, '{kind.name}' AS kind, start, start + length(m) AS finish,
       {kind.own} + CASE WHEN regexp_matches(lower(substr(t, greatest(start - {WINDOW}, 0) + 1, start - greatest(start - {WINDOW}, 0)) || ' '
         || substr(t, start + length(m) + 1, {WINDOW})), '{kind.context}') THEN {kind.near} ELSE 0.0 END AS score
FROM (SELECT doc_id, t, m, start, CASE WHEN start > 0 THEN substr(t, start, 1) ELSE '' END AS before, substr(t, start + length(m) + 1, 1) AS after
      FROM (SELECT doc_id, t, ms[i] AS m, cast(list_sum(list_transform(bs[1:i], lambda b: length(b)))
                   + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
            FROM (SELECT doc_id, t, ms, bs, unnest(range(1, len(ms) + 1)) AS i
                  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS bs FROM texts))))
WHERE {valid}"""


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT * FROM ({" UNION ALL ".join(f"({_oracle_kind(k)})" for k in KINDS)}) WHERE score >= {THRESHOLD})
SELECT d.doc_id,
       {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
       sha256(coalesce(string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY k, start) FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY k, start), '') AS spans,
       count(kind) AS n_spans, round(coalesce(max(cast(score AS DOUBLE)), 0.0), 2) AS top_score
FROM texts d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
