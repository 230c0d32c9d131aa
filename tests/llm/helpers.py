from __future__ import annotations

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "The Cat sat on the mat today", "en", "a", 28),
    (2, "the cat SAT on the mat today", None, "a", 28),
    (3, None, "en", "b", None),
    (4, "", "en", None, 0),
    (5, "É È one", "fr", "a", 7),
    (6, "é è one", "fr", "a", 7),
    (7, "word " * 40000, "en", "long", 200000),
    (8, "the cat SAT on the mat today", "en", "a", 28),
    (8, "the cat SAT on the mat today", "en", "a", 28),
    (None, "the cat SAT on the mat today", "en", "a", 28),
    (None, "no id here", "de", "c", 10),
]


def docs(spark, rows=ODD, schema=DOCS):
    """Stored rows, since operators may ask for a stored table."""
    return spark.createDataFrame(rows, schema)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def clashing(spark):
    """Extra columns whose names an operator might use itself."""
    names = ["uid", "id", "digest", "salt", "n", "best", "total", "text_bytes", "row", "local_uid", "length", "key", "token", "size", "node"]
    return spark.createDataFrame([(k, t, *range(len(names))) for k, t, *_ in ODD[:6]], "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
