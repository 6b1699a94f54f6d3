"""Judge answers: tolerant parsing, validation, flat and long forms, and what is left to be judged."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrain.functions.text import strip
from notegrain.operators.generation import strip_think

#: Keys of the judge's answer.
SCORES = ("actualizada_temporalmente_correcta", "precisa", "exhaustiva", "util", "organizada", "comprensible", "concisa", "sintetizada", "consistencia_interna")
FLAGS = ("error_seguridad_grave", "contradicciones_clinicas_insalvables", "human_generated")
#: Parts of names that no generated note has.
BANNED = ("report", "analysis", "stats", "summary", "metric", "metrics", "log", "readme")


def parse_json(text: Column) -> Column:
    """Variant of an answer, or of its outermost braces; null if neither parses."""
    plain = strip_think(text, any_case=False)
    return F.coalesce(F.try_parse_json(plain), F.try_parse_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0)))


def complete_answer(text: str) -> bool:
    """Whether an answer parses (see parse_json) and has all nine scores; asked of each answer where it arrives."""
    plain = re.sub(r"(?s)<think>.*?</think>", "", text or "").strip()
    braces = re.search(r"(?s)\{.*\}", plain)
    for part in (plain, braces[0] if braces else ""):
        try:
            found = json.loads(part)
            break
        except ValueError:
            continue
    else:
        return False
    try:
        return all(1 <= int(found[k]["score"]) <= 5 for k in SCORES)
    except (KeyError, TypeError, ValueError, OverflowError):
        return False


def as_flag(value: Column, path: str) -> Column:
    """Booleans, words for them, and numbers; all else is false."""
    word = F.lower(strip(F.try_variant_get(value, path, "string")))
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    number = F.try_variant_get(value, path, "double")
    text = F.when(word.isin("true", "1", "yes", "si", "sí"), True).otherwise(False)
    return F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.try_variant_get(value, path, "boolean")).when(number.isNotNull(), number != 0).otherwise(F.lit(False))


def validated(answers: DataFrame) -> DataFrame:
    """strategy, file_name, relative_path, raw_text and others -> all but raw_text, and parse_error, <score>, <score>_justification, flags."""
    # exploded, so that a filter on the result doesn't parse anew for each score
    rows = answers.select("*", F.explode(F.array(parse_json(F.coalesce("raw_text", F.lit(""))))).alias("v"))
    kind = F.schema_of_variant(F.col("v"))
    error = F.when(F.col("v").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "unexpected_type")
    columns = []
    for key in SCORES:
        number = F.try_variant_get("v", f"$.{key}.score", "int")
        score = F.when(number.between(1, 5), number)
        is_text = F.schema_of_variant(F.try_variant_get("v", f"$.{key}.justification", "variant")) == "STRING"
        words = F.when(is_text, F.try_variant_get("v", f"$.{key}.justification", "string")).otherwise("")
        columns += [score.alias(f"{key}_score"), F.when(score == 5, "").otherwise(strip(words)).alias(f"{key}_justification")]
    return rows.select(*[c for c in answers.columns if c != "raw_text"], error.alias("parse_error"), *columns, *[as_flag(F.col("v"), f"$.{k}").alias(k) for k in FLAGS])


def flat_rows(answers: DataFrame, model: str, provider: str) -> DataFrame:
    """validated answers (with file_path) as the results file has them: 27 columns, and parse_error."""
    known = [F.col("file_name").alias("filename"), "strategy", "relative_path", F.col("file_path").alias("filepath"), F.lit(model).alias("model"), F.lit(provider).alias("provider")]
    scores = [c for k in SCORES for c in (f"{k}_score", f"{k}_justification")]
    return validated(answers).select(*known, *scores, *FLAGS, "parse_error")


def success_records(answers: DataFrame, model: str, provider: str) -> DataFrame:
    """filename, strategy, relative_path, filepath, model, provider, result (scores with justifications, and flags)."""
    result = [F.struct(F.col(f"{k}_score").alias("score"), F.col(f"{k}_justification").alias("justification")).alias(k) for k in SCORES]
    return flat_rows(answers, model, provider).select("filename", "strategy", "relative_path", "filepath", "model", "provider", F.struct(*result, *FLAGS).alias("result"))


def error_records(answers: DataFrame, model: str, provider: str) -> DataFrame:
    """The same of notes without a valid answer, with parse_error for the result."""
    return answers.select(F.col("file_name").alias("filename"), "strategy", "relative_path", F.col("file_path").alias("filepath"), F.lit(model).alias("model"), F.lit(provider).alias("provider"), F.col("error").alias("parse_error"))


def complete(flat: DataFrame) -> DataFrame:
    """Rows whose nine scores are all there."""
    every = F.col("parse_error").isNull()
    for key in SCORES:
        every = every & F.col(f"{key}_score").between(1, 5)
    return flat.where(every)


def scores_long(flat: DataFrame) -> DataFrame:
    """A row for each score."""
    each = F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"{k}_score").alias("score"), F.col(f"{k}_justification").alias("justification")) for k in SCORES])
    return flat.select("strategy", "file_name", F.explode(each).alias("s")).select("strategy", "file_name", "s.*")


def valid_note_names(names: DataFrame) -> DataFrame:
    """file_name: .txt, and none of the banned parts in it."""
    low = F.lower("file_name")
    return names.where(low.endswith(".txt") & ~low.rlike("|".join(BANNED)))


def pending(notes: DataFrame, completed: DataFrame) -> DataFrame:
    """Notes to be judged: no completed note of any strategy has the name, and of namesakes the first comes first (turn 1).

    A later turn is judged only if all turns before it failed.
    """
    left = notes.join(completed.select("file_name").distinct(), "file_name", "left_anti")
    turn = F.row_number().over(Window.partitionBy("file_name").orderBy("strategy", "relative_path"))
    return left.withColumn("turn", turn)


def csv_score_valid(value: Column) -> Column:
    """A score as read back from CSV: an error word is none, and 4.7 counts as 4."""
    word = F.lower(F.trim(value))
    number = word.try_cast("double").try_cast("int")
    return ~F.coalesce(word, F.lit("")).isin("", "nan", "none", "null") & F.coalesce(number.between(1, 5), F.lit(False))
