from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from weftline.functions import text


def told(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    return [r.x for r in rows.select(column(F.col("v")).alias("x")).collect()]


def test_head_clauses(spark):
    found = told(
        spark, text.head_clause, "The object is a magazine release button", "The round dining table top is a flat surface that serves", "A gray helmet, serving as protection, and more",
        "a wheel, which is a component of the sleigh", ", located on top", "It is a hat", None, "",
    )
    assert found == ["a magazine release button", "The round dining table top", "A gray helmet", "a wheel", ", located on top", "a hat", "", ""]


def test_phrases_and_words(spark):
    assert told(spark, text.phrase, "A Red Hat. ", "", "Übung.") == ["a Red Hat", "", "übung"]
    assert told(spark, text.keywords, "A Large round-top Wheel of the wheel, part of it", None) == [["round", "top", "wheel"], []]
    assert told(spark, text.as_phrase, "lamp", "red lamp") == ["a lamp", "red lamp"]
    assert told(spark, text.head_noun, "A wheel from the cart", "bowl ofx", "wheel in") == ["a wheel", "bowl ofx", "wheel"]
    assert told(spark, text.slug, "A  Red--Hat!", "***", "x" * 30) == ["a_red_hat", "part", "x" * 18]


def test_admission(spark):
    rows = ["a horn", "a close-up of a horn", "a wall lamp", "a toilet seat", "a black piece", "a segment of the panel", "", None, "a wallpaper roll", "an element of style"]
    assert told(spark, text.is_admitted, *rows) == [True, False, False, False, False, False, False, False, True, True]


def test_clean_captions(spark):
    assert told(spark, text.clean_caption, ' "Sentence: A red\n hat. It is big." ', "*one*", "v1.5 wheel", "", None) == ["A red hat.", "one.", "v1.5 wheel.", "", ""]


def test_front_axes(spark):
    said = ["faces +z", "toward the negative x axis", "no intrinsic front", "It points z", "front is -x", "", "faces y"]
    assert told(spark, text.front_axis, *said) == ["+z", "-x", None, "+z", "-x", None, None]


def test_swapped_sides(spark):
    assert told(spark, text.swap_sides, "Left of the right, leftover LEFT Right", "none") == ["Right of the left, leftover RIGHT Left", "none"]
    assert told(spark, text.swap_sides_zh, "左右左") == ["右左右"]


def test_answers_of_models(spark):
    good = '```json\n{"brief": "a", "detailed": "b"}\n```'
    assert [x and (x.brief, x.detailed) for x in told(spark, text.parse_caption, good, '{"brief": "a"}', "no", None)] == [("a", "b"), None, None, None]
    turns = '<think>{"x"}</think> {"front": "+z", "turns": [{"n": 1, "text": "t", "zh": "z"}]} tail'
    found = told(spark, lambda c: text.parse_turns(c, F.lit(1)), turns, turns.replace('"zh": "z"', '"n": 2'), "{", None)
    assert found[0].turns[0].text == "t" and found[1:] == [None, None, None]
    assert told(spark, lambda c: text.parse_turns(c, F.lit(2)), turns) == [None]


@pytest.mark.parametrize(("op", "want"), [("add", "Add a cap to the top."), ("remove", "Remove the hat."), ("retexture", "Change the material of the hat to a cap."), ("replace", "Replace the hat with a cap.")])
def test_sentences(spark, op, want):
    assert told(spark, lambda c: text.edit_sentence(c, F.lit("a hat"), F.lit("a cap"), F.lit("the top")), op) == [want]
