"""Caption and instruction text as column expressions.

Patterns are kept in a form that the regular expression engines of Spark and of the SQL they are checked against read alike:
classes are ASCII, and word boundaries are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of captions.
LEAD = r"(?i)^\s*(the object is|this is|it is|the image shows)\s+"
COPULA = r"(?i)^((?:the|a|an)\s+(?:[\w'-]+\s+){1,7}[\w'-]+)\s+(?:is|are)\s+(?:a|an|the)\s"
TAIL = (
    r"(?i),\s+(?:which\s+(?:is|was)|a component|part of|from the|serving\s|located\s|featuring\s|designed\s|used\s|consisting\s|"
    r"forming\s|providing\s|including\s|attached\s|connected\s)"
)
_OPEN, _CLOSE = r"(?i)(?:^|[^A-Za-z0-9_])", r"(?:$|[^A-Za-z0-9_])"
BAD = _OPEN + r"(?:close-?up (?:of|view)|detailed view of|a section of|(?:view|shot|render) of)" + _CLOSE
SCENE = _OPEN + r"(?:floor|wall|ground|ceiling|backdrop|tile[ds]? surface|base plate|platform|terrain|grass patch)" + _CLOSE
TABOO = _OPEN + r"(?:toilet|urinal|bidet|sewage|septic|trash|garbage|waste|dumpster|feces|manure|litter box)" + _CLOSE
FRAGMENT = r"(?i)^(?:a|an|the)\s+(?:segment|portion|fragment|sliver|strip|patch)\s+of" + _CLOSE
GENERIC = (
    r"(?i)^(?:a|an|the)\s+(?:[\w\s,'-]*[^A-Za-z0-9_])?"
    r"(?:component|piece|element|object|part|section|block|shape|structure|unit|item|fragment)\s*$"
)
HEAD_NOUN = r"\s+(?:from|of|with|for|on|in|at)" + _CLOSE
# The words that are no keywords.
STOP = (
    "a an the of from is are this that it its with and or in on to for which was were be been part component object image shows "
    "appears extracted detached removed isolated close up left right red box larger main small large"
).split()
FRONT = (
    r"(?:faces?|facing|towards?|points?|pointing)\s*(?:the\s+)?(?:direction\s+)?(?:of\s+)?(?:the\s+)?"
    r"([+-]|positive|negative|minus|plus)?\s*([xz])(?:[\s-]*axis)?"
)
FRONT_SHORT = r"([+-]|positive|negative)\s*([xz])(?:$|[^A-Za-z0-9_])"


def head_clause(caption: Column) -> Column:
    """What the thing is: no opening phrase, only the subject of a copula, nothing from the first trailing clause on."""
    plain = F.regexp_replace(F.coalesce(caption, F.lit("")), LEAD, "")
    subject = F.regexp_extract(plain, COPULA, 1)
    said = F.when(subject != "", subject).otherwise(plain)
    before = F.split(said, TAIL, 2)[0]
    return F.when(before == "", said).otherwise(before)


def phrase(caption: Column) -> Column:
    """The head clause as it stands in a sentence: trimmed, without closing dots, its first letter small."""
    said = F.rtrim(F.trim(head_clause(caption)), F.lit(". "))
    return F.concat(F.lower(F.substring(said, 1, 1)), F.substr(said, F.lit(2)))


def keywords(caption: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words, sorted."""
    letters = F.regexp_replace(F.lower(head_clause(caption)), "[^a-z ]", " ")
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.array_sort(F.array_distinct(F.filter(F.split(letters, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))))


def is_generic(caption: Column) -> Column:
    head = F.rtrim(F.trim(head_clause(caption)), F.lit("."))
    return head.rlike(GENERIC) | head.rlike(FRAGMENT)


def is_admitted(caption: Column) -> Column:
    """Whether a caption may enter the library: it names a thing that can be taken and placed."""
    filled = F.coalesce(caption, F.lit(""))
    return (F.trim(filled) != "") & ~filled.rlike(BAD) & ~filled.rlike(SCENE) & ~filled.rlike(TABOO) & ~is_generic(caption)


def as_phrase(word: Column) -> Column:
    return F.when(F.instr(word, " ") > 0, word).otherwise(F.concat(F.lit("a "), word))


def head_noun(text: Column) -> Column:
    return F.lower(F.trim(F.split(text, HEAD_NOUN, 2)[0]))


def slug(text: Column, size: int = 18, empty: str = "part") -> Column:
    cut = F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), 1, size)
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def clean_caption(text: Column) -> Column:
    """One sentence: spaces folded, quotes and stars off the ends, no label, the first sentence only, a dot at its end."""
    said = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\f\r]+", " "))
    for sign in ('"', "'", "*"):
        said = F.trim(F.trim(said, F.lit(sign)))
    said = F.trim(F.regexp_replace(said, r"(?i)^sentence:", ""))
    first = F.split(said, r"\. ", 2)[0]
    return F.when(said == "", "").otherwise(F.concat(F.when(F.length(first) < F.length(said), first).otherwise(F.regexp_replace(said, r"\.$", "")), F.lit(".")))


def is_long_enough(cleaned: Column) -> Column:
    return F.length(cleaned) >= 12


def front_axis(sentence: Column) -> Column:
    """The signed horizontal axis that a sentence names; null where it names none. Without a sign it is the positive one."""
    low = F.lower(sentence)
    long, short = (F.regexp_extract(low, p, 2) for p in (FRONT, FRONT_SHORT))
    sign = F.when(long != "", F.regexp_extract(low, FRONT, 1)).otherwise(F.regexp_extract(low, FRONT_SHORT, 1))
    axis = F.when(long != "", long).otherwise(short)
    return F.when((F.instr(low, "no intrinsic") == 0) & (axis != ""), F.concat(F.when(sign.isin("-", "negative", "minus"), "-").otherwise("+"), axis))


def says(text: Column, word: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_OPEN + word + _CLOSE)


def swap_sides(text: Column) -> Column:
    """Left for right and right for left, as whole words, in the case they have."""
    out = text
    for word, other in (("left", "right"), ("Left", "Right"), ("LEFT", "RIGHT")):
        away = F.regexp_replace(out, rf"(?-i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", "\u0001")
        out = F.replace(F.regexp_replace(away, rf"(?<![A-Za-z0-9_]){other}(?![A-Za-z0-9_])", word), F.lit("\u0001"), F.lit(other))
    return out


def swap_sides_zh(text: Column) -> Column:
    return F.translate(text, "左右", "右左")


def parse_caption(text: Column) -> Column:
    """A caption object in a model's answer, fences stripped: (brief, detailed), or null if either is missing."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*|```$", "")
    got = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), "brief string, detailed string")
    return F.when(got["brief"].isNotNull() & got["detailed"].isNotNull(), got)


def parse_turns(text: Column, turns: Column) -> Column:
    """Instructions in a model's answer, its thoughts dropped; null unless it has so many turns, each with text and zh."""
    answer = F.regexp_extract(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
    got = F.from_json(answer, "front string, turns array<struct<n:int,text:string,zh:string>>")
    whole = (F.size(got["turns"]) == turns) & F.forall(got["turns"], lambda t: t["text"].isNotNull() & t["zh"].isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), got)


def edit_sentence(op: Column, old: Column, new: Column, place: Column) -> Column:
    """The instruction of an edit, from its parts."""
    without = F.regexp_replace(old, r"(?i)^(?:a|an|the)\s+", "")
    return (
        F.when(op == "add", F.concat_ws("", F.lit("Add "), new, F.lit(" to "), place, F.lit(".")))
        .when(op == "remove", F.concat_ws("", F.lit("Remove the "), without, F.lit(".")))
        .when(op == "retexture", F.concat_ws("", F.lit("Change the material of the "), without, F.lit(" to "), new, F.lit(".")))
        .otherwise(F.concat_ws("", F.lit("Replace the "), without, F.lit(" with "), new, F.lit(".")))
    )


def signature(items: Column, size: int = 8) -> Column:
    """Equal for equal sets of texts, whatever their order."""
    return F.substring(F.sha1(F.to_json(F.array_sort(items))), 1, size)
