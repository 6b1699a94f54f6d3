"""Deduplicating and merging mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrain.functions.text import collapse


def exact(mentions: DataFrame, *keys: str) -> DataFrame:
    """One mention of those equal in keys, label, start, end and cleaned text: the first by text, then arrival."""
    clean = collapse(F.coalesce(F.col("text"), F.lit("")))
    order = Window.partitionBy(*keys, "label", "start", "end", "clean text").orderBy("text", "arrival")
    ranked = mentions.withColumn("clean text", clean).withColumn("rank of a mention", F.row_number().over(order))
    return ranked.where(F.col("rank of a mention") == 1).drop("clean text", "rank of a mention")


def by_span_and_label(mentions: DataFrame, *keys: str, carried: tuple[str, ...] = ("text",)) -> DataFrame:
    """Mentions folded in order of arrival: the first kept one of the label that shares a start or an end with the newcomer
    is replaced if shorter (the newcomer then stands last), else the newcomer goes. Only a label's mentions meet, so the
    fold is over those of one key and label; they are few by nature (its time grows with their square).
    """
    item = F.struct("arrival", "start", "end", *carried)
    folded = mentions.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept, new):  # noqa: ANN001, ANN202
        shares = F.transform(kept, lambda k: (k["start"] == new["start"]) | (k["end"] == new["end"]))
        at = F.array_position(shares, F.lit(True)).cast("int")
        old = F.get(kept, at - 1)
        longer = (new["end"] - new["start"]) > (old["end"] - old["start"])
        without = F.filter(kept, lambda _, i: i != at - 1)
        return F.when(at == 0, F.concat(kept, F.array(new))).when(longer, F.concat(without, F.array(new))).otherwise(kept)

    none = F.filter(F.col("items"), lambda _: F.lit(False))
    return folded.select(*keys, "label", F.explode(F.aggregate("items", none, step)).alias("m")).select(*keys, "label", "m.start", "m.end", *[f"m.{c}" for c in carried])


def merged(documents: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Mentions of all sources in their order, deduplicated; documents without mentions have one row of nulls."""
    first, *others = [s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)]
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    arrival = F.col("source") * F.lit(1 << 40) + F.col("arrival")
    kept = exact(first.withColumn("arrival", arrival), "file_name")
    return documents.join(kept.drop("arrival"), "file_name", "left")
