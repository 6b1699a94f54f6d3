"""Standoff annotation lines: parsing for the metrics and for the tagger, and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrain.functions.text import comparable_span, strip


def parse_lines(lines: DataFrame, case_sensitive: bool = False, normalize: bool = True) -> DataFrame:
    """file_name, line -> entities as the metrics read them: no discontinuous spans, end after start."""
    line = strip(F.col("line"))
    parts = F.split(line, "\t")
    read = lines.select("file_name", line.alias("line"), parts.alias("p")).where(F.col("line").startswith("T") & (F.size("p") >= 3))
    head = F.split(strip(F.get("p", F.lit(1))), r"\s+")
    read = read.select("file_name", F.get("p", F.lit(0)).alias("entity_id"), F.get("p", F.lit(1)).alias("middle"), head.alias("h"), F.array_join(F.slice("p", 3, F.size("p")), "\t").alias("raw"))
    start, end = F.get("h", F.lit(1)).try_cast("int"), F.get("h", F.lit(2)).try_cast("int")
    kept = read.where(~F.col("middle").contains(";") & (F.size("h") == 3)).select("file_name", "entity_id", F.get("h", F.lit(0)).alias("label"), start.alias("start"), end.alias("end"), comparable_span(F.col("raw"), case_sensitive, normalize).alias("text"))
    return kept.where("start is not null and end is not null and end > start")


def parse_spans(lines: DataFrame) -> DataFrame:
    """file_name, line -> label, start, end as the tagger reads them: a row for each part of a discontinuous span."""
    parts = F.split(F.col("line"), "\t")
    read = lines.select("file_name", parts.alias("p")).where(F.get("p", F.lit(0)).startswith("T") & (F.size("p") >= 2))
    middle = strip(F.get("p", F.lit(1)))
    split = read.select("file_name", F.regexp_extract(middle, r"^(\S+)\s+(.*)$", 1).alias("label"), F.explode(F.split(F.regexp_extract(middle, r"^(\S+)\s+(.*)$", 2), ";")).alias("part"))
    part = strip(F.col("part"))
    numbers = [F.regexp_extract(part, r"^(\d+)\s+(\d+)$", k).try_cast("int") for k in (1, 2)]
    return split.select("file_name", "label", numbers[0].alias("start"), numbers[1].alias("end")).where("label <> '' and start is not null and end > start")


def ann_lines(entities: DataFrame, clean_label: bool = True) -> DataFrame:
    """file_name, label, start, end, text -> numbered standoff lines; texts without line feeds.

    With clean_label also labels are without blanks and texts without carriage returns, which else stay.
    """
    number = F.row_number().over(Window.partitionBy("file_name").orderBy("start", "end", "label", "text"))
    label = F.replace(F.col("label"), F.lit(" "), F.lit("_")) if clean_label else F.col("label")
    flat = F.translate(F.col("text"), "\r\n", "  ") if clean_label else F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("T"), number.cast("string"), F.lit("\t"), label, F.lit(" "), F.col("start").cast("string"), F.lit(" "), F.col("end").cast("string"), F.lit("\t"), flat)
    return entities.select("file_name", number.alias("number"), line.alias("line"))


def ann_documents(lines: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """file_name, content: one text for each file; entities of a file are few by nature. documents without lines are empty."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "line")))
    found = lines.groupBy("file_name").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    if documents is None:
        return found
    return documents.select("file_name").join(found, "file_name", "left").select("file_name", F.coalesce("content", F.lit("")).alias("content"))
