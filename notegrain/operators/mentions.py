"""PSA and Gleason mentions with offsets in the normalised text; one pass over each note, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrain.functions.numeric import gleason_total, psa_unit, to_double, to_ng_per_ml
from notegrain.functions.text import find_all, let, normalize_text, snippet

#: Characters of a note that the regular expressions read at most: a limit of the feature.
MOST_CHARACTERS = 400_000

#: The grammars of quantities and scores.
NUMBER = r"(?:\d{1,3}(?:[.\s]\d{3})+|\d+)(?:[.,]\d+)?"
UNIT = r"(?:ng\s*/\s*mL|ng\s*/\s*ml|ng\s*/\s*L|ng\s*/\s*l|ng\s*mL|ng\s*ml|ng\s*L|ng\s*l)"
QUANTITY = rf"({NUMBER})\s*({UNIT})\b"
KEYWORD = r"(?:\bgleason\b|puntuaci[oó]n\s+de\s+gleason|score\s+de\s+gleason|escala\s+de\s+gleason)"
TOTAL = r"(?:10|[2-9]|(?:X|IX|IV|V?I{0,3}))"
PART = r"(?:[1-5])"
BETWEEN = r"(?:\+|/)"
AFTER_KEYWORD = r"(?:\s*[:=]?\s*)"
IN_BRACKETS = rf"(?:\s*[\(\[\{{]\s*({PART})\s*{BETWEEN}\s*({PART})\s*[\)\]\}}])"
#: name, pattern, and the numbers of the groups total, primary, secondary (0: none). The first to take a span keeps it.
#: A fourth form, sum_in_parens, finds nothing: TOTAL may be empty, so total_then_sum takes all that it could.
GLEASON = (
    ("total_then_sum", rf"{KEYWORD}{AFTER_KEYWORD}({TOTAL}){IN_BRACKETS}", (1, 2, 3)),
    ("sum_total", rf"{KEYWORD}{AFTER_KEYWORD}({PART})\s*{BETWEEN}\s*({PART})(?:\s*(?:=|→|->)\s*({TOTAL}))?", (3, 1, 2)),
    ("score_only", rf"{KEYWORD}{AFTER_KEYWORD}({TOTAL})\b", (1, 0, 0)),
)
_FLAGS = "(?iU)"


def _read(text: Column) -> Column:
    return normalize_text(F.substring(text, 1, MOST_CHARACTERS))


def psa_mentions(notes: DataFrame) -> DataFrame:
    """doc_id, text -> a row for each quantity in ng/mL or ng/L, numbered in its note; value_num is null if unreadable."""
    found = notes.select("doc_id", _read(F.col("text")).alias("t")).select("doc_id", "t", F.posexplode(find_all(F.col("t"), _FLAGS + QUANTITY, (("value", 1), ("unit", 2)))))
    value, unit = to_double(F.col("col.value")), psa_unit(F.col("col.unit"))
    return found.select(
        "doc_id", (F.col("pos") + 1).alias("match_index"), F.lit("PSA").alias("label"), F.col("col.value").alias("value_raw"), value.alias("value_num"), F.col("col.unit").alias("unit_raw"),
        unit.alias("unit_norm"), to_ng_per_ml(value, unit).alias("value_ng_ml"), F.col("col.start").alias("start"), F.col("col.end").alias("end"),
        snippet(F.col("t"), F.col("col.start"), F.col("col.end")).alias("snippet"), F.col("col.text").alias("text"),
    )


def per_note(notes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, mentions: how many each note has, none included."""
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    return notes.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("mentions"))


def _pattern_array(text: Column, name: str, pattern: str, groups: tuple[int, int, int]) -> Column:
    """One pattern's matches; groups that it lacks are empty."""
    total, first, second = groups
    none = F.lit("")

    def named(m: Column) -> Column:
        parts = (m["p1"], m["p2"]) if first else (none, none)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(name).alias("pattern_type"), m["tot"].alias("tot"), parts[0].alias("p1"), parts[1].alias("p2"))

    return F.transform(find_all(text, _FLAGS + pattern, tuple((n, k) for n, k in (("tot", total), ("p1", first), ("p2", second)) if k)), named)


def _without_overlaps(x: Column) -> Column:
    """x.a and those of x.m that overlap none of them."""
    return F.concat(x["a"], F.filter(x["m"], lambda m: ~F.exists(x["a"], lambda a: (m["start"] < a["end"]) & (m["end"] > a["start"]))))


def _gleason_array(text: Column) -> Column:
    """Mentions of all patterns, those overlapping an earlier pattern's left out."""
    first, *others = [_pattern_array(text, *p) for p in GLEASON]
    for matches in others:
        first = let(F.struct(first.alias("a"), matches.alias("m")), _without_overlaps)
    # every keyword has this word in it
    return F.when(text.rlike(_FLAGS + "gleason"), F.array_sort(first)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,pattern_type:string,tot:string,p1:string,p2:string>>"))


def gleason_mentions(notes: DataFrame) -> DataFrame:
    """doc_id, text -> a row for each Gleason mention; a stated total stands, else the parts are added."""
    found = notes.select("doc_id", _read(F.col("text")).alias("t")).select("doc_id", "t", F.posexplode(_gleason_array(F.col("t"))))
    primary, secondary = F.col("col.p1").try_cast("int"), F.col("col.p2").try_cast("int")
    return found.select(
        "doc_id", (F.col("pos") + 1).alias("match_index"), F.lit("GLEASON").alias("label"), F.col("col.text").alias("gleason_raw"), F.col("col.pattern_type").alias("pattern_type"), primary.alias("primary"),
        secondary.alias("secondary"), F.coalesce(gleason_total(F.col("col.tot")), primary + secondary).alias("total"), F.col("col.start").alias("start"), F.col("col.end").alias("end"),
        snippet(F.col("t"), F.col("col.start"), F.col("col.end")).alias("snippet"), F.col("col.text").alias("text"),
    )
