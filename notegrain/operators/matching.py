"""Relaxed one-to-one matching of predicted to silver entities, and its metrics.

Candidates share file and label, and start or end. Priority comes first in the greedy order, so the assignment falls
apart into three phases: exact pairs by rank; then, among what is left, pairs of one start, nearest end first; then pairs
of one end, nearest start first.

Both sides go through one exchange, by file, and all phases run within its partitions: exact pairs are neighbours in a
window, and the later phases fold the few entities of one label that begin (end) at one place. Files are paired by
name, from the folders' own lists, so a file in which one side found nothing counts with all its misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrain.functions.numeric import rates
from notegrain.functions.text import let

_ENTITY = ("entity_id", "start", "end", "text")


def paired_files(silver_files: DataFrame, predicted_files: DataFrame) -> DataFrame:
    """file_name of the files that both lists have."""
    return silver_files.select("file_name").distinct().join(predicted_files.select("file_name").distinct(), "file_name", "left_semi")


def candidates(silver: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of one file and label that share a start or an end, with priority 0 exact, 1 start, 2 end."""
    s = silver.select("file_name", "label", *[F.col(c).alias(f"silver_{c}") for c in _ENTITY])
    p = predicted.select("file_name", "label", *[F.col(c).alias(f"pred_{c}") for c in _ENTITY])
    keys = ["file_name", "label"]
    starts = s.join(p.withColumn("silver_start", F.col("pred_start")), [*keys, "silver_start"])
    ends = s.join(p.withColumn("silver_end", F.col("pred_end")), [*keys, "silver_end"]).where("silver_start <> pred_start")
    columns = [*keys, "silver_entity_id", "silver_start", "silver_end", "pred_entity_id", "pred_start", "pred_end"]
    both = starts.select(*columns).unionByName(ends.select(*columns))
    priority = F.when((F.col("silver_start") == F.col("pred_start")) & (F.col("silver_end") == F.col("pred_end")), 0).when(F.col("silver_start") == F.col("pred_start"), 1).otherwise(2)
    return both.withColumn("priority", priority).withColumn("span_distance", F.abs(F.col("silver_start") - F.col("pred_start")) + F.abs(F.col("silver_end") - F.col("pred_end")))


def _exact(silver: DataFrame, predicted: DataFrame, files: DataFrame | None) -> DataFrame:
    """file_name, label, s, p, match_type: exact pairs, and the other entities with null for the other side."""
    side = lambda df, k: df.select("file_name", "label", *_ENTITY, F.lit(k).alias("side"))
    both = side(silver, 0).unionByName(side(predicted, 1)).repartition("file_name")
    if files is not None:
        both = both.join(files.select("file_name"), "file_name", "left_semi")
    # place: among the side's entities of file and label; turn: among those of one span. One sort does for both
    own = Window.partitionBy("file_name", "label", "side").orderBy("start", "end", "text", "entity_id")
    span = Window.partitionBy("file_name", "label", "side", "start", "end").orderBy("text", "entity_id")
    ranked = both.select("file_name", "label", "side", "start", "end", F.row_number().over(span).alias("turn"), F.struct(F.row_number().over(own).alias("place"), *_ENTITY).alias("e"))
    meeting = Window.partitionBy("file_name", "label", "start", "end", "turn").orderBy("side")
    met = ranked.withColumn("mate", F.lead("e").over(meeting)).withColumn("k", F.row_number().over(meeting)).where("k = 1")
    silver_e, pred_e = F.when(F.col("side") == 0, F.col("e")), F.when(F.col("side") == 1, F.col("e")).otherwise(F.col("mate"))
    return met.select("file_name", "label", silver_e.alias("s"), pred_e.alias("p"), F.when(F.col("mate").isNotNull(), "exact").alias("match_type"))


def _greedy(pairs: Column) -> Column:
    """Fold of sorted (distance, i, j): taken if both are free."""
    empty = F.filter(pairs, lambda _: F.lit(False))
    return F.aggregate(pairs, empty, lambda kept, x: F.when(F.exists(kept, lambda k: (k["i"] == x["i"]) | (k["j"] == x["j"])), kept).otherwise(F.concat(kept, F.array(x))))


def _matched(items: Column, other: str, name: str) -> Column:
    """Rows of one label and shared bound, with what is open on both sides paired, nearest first."""

    def opened(mine: str, theirs: str) -> Column:
        # by place, which comes first in the struct
        return F.array_sort(F.transform(F.filter(items, lambda x: x[theirs].isNull()), lambda x: x[mine]))

    def pair_up(v: Column) -> Column:
        distance = lambda a, b: F.abs(a[other] - b[other])
        pairs = F.flatten(F.transform(v["s"], lambda a, i: F.transform(v["p"], lambda b, j: F.struct(distance(a, b).alias("d"), i.alias("i"), j.alias("j")))))
        return let(_greedy(F.array_sort(pairs)), lambda taken: rows(v, taken))

    def rows(v: Column, taken: Column) -> Column:
        row = lambda s, p, kind: F.struct(s.alias("s"), p.alias("p"), kind.alias("match_type"))
        none, entity = F.lit(None).cast("string"), F.lit(None).cast("struct<place:int,entity_id:string,start:int,end:int,text:string>")
        left = lambda side, k: F.filter(v[side], lambda _, at: ~F.exists(taken, lambda t: t[k] == at))
        return F.concat(
            F.filter(items, lambda x: x["s"].isNotNull() & x["p"].isNotNull()),
            F.transform(taken, lambda t: row(F.get(v["s"], t["i"]), F.get(v["p"], t["j"]), F.lit(name))),
            F.transform(left("s", "i"), lambda e: row(e, entity, none)),
            F.transform(left("p", "j"), lambda e: row(entity, e, none)),
        )

    alone = lambda mine: F.exists(items, lambda x: x[mine].isNull())
    return F.when(alone("s") & alone("p"), let(F.struct(opened("s", "p").alias("s"), opened("p", "s").alias("p")), pair_up)).otherwise(items)


def _phase(rows: DataFrame, shared: str, other: str) -> DataFrame:
    """Greedy pairs among open entities of one file, label and shared bound; what is paired already passes through."""
    bound = F.coalesce(F.col(f"s.{shared}"), F.col(f"p.{shared}")).alias("bound")
    grouped = rows.groupBy("file_name", "label", bound).agg(F.collect_list(F.struct("s", "p", "match_type")).alias("items"))
    return grouped.select("file_name", "label", F.explode(_matched(F.col("items"), other, f"same_{shared}")).alias("x")).select("file_name", "label", "x.*")


def comparisons(silver: DataFrame, predicted: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each true positive, false negative and false positive, with both sides' spans; the absent side is null.

    files: file_name of the files to compare (see paired_files); without it, every file that either side has entities of.
    """
    matched = _phase(_phase(_exact(silver, predicted, files), "start", "end"), "end", "start")
    status = F.when(F.col("s").isNull(), "FP").when(F.col("p").isNull(), "FN").otherwise("TP")
    kind = F.coalesce("match_type", F.when(F.col("s").isNull(), "unmatched_pred").otherwise("unmatched_silver"))
    same = lambda c: F.coalesce((F.col(f"s.{c}") == F.col(f"p.{c}")).cast("int"), F.lit(0)).alias(f"same_{c}")
    both = (F.col("s").isNotNull() & F.col("p").isNotNull()).cast("int").alias("same_label")
    sides = [F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("s", "silver"), ("p", "pred")) for c in _ENTITY]
    return matched.select("file_name", "label", status.alias("status"), kind.alias("match_type"), *sides, both, same("start"), same("end"), same("text"))


def in_report_order(compared: DataFrame) -> DataFrame:
    """By file; true positives by priority and distance, then false negatives, then false positives, each by place."""
    rank = lambda c, *names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    distance = F.abs(F.col("silver_start") - F.col("pred_start")) + F.abs(F.col("silver_end") - F.col("pred_end"))
    place = lambda n: [f"{n}_start", f"{n}_end", "label", f"{n}_text", f"{n}_entity_id"]
    return compared.orderBy("file_name", rank("status", "TP", "FN", "FP"), rank("match_type", "exact", "same_start", "same_end"), distance, *place("silver"), *place("pred"))


_COUNTS = ("tp", "fp", "fn")


def _counted() -> list[Column]:
    return [F.count_if(F.col("status") == s.upper()).alias(s) for s in _COUNTS]


def _rated(counts: DataFrame, *others: str) -> DataFrame:
    tp, fp, fn = map(F.col, _COUNTS)
    return counts.select(*others, *_COUNTS, *rates(tp, fp, fn))


def file_metrics(compared: DataFrame, files: DataFrame) -> DataFrame:
    """Counts and rates of each file, also of files without entities."""
    counted = files.select("file_name").join(compared.groupBy("file_name").agg(*_counted()), "file_name", "left")
    whole = counted.select("file_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS])
    sums = whole.withColumns({"silver_entities": F.col("tp") + F.col("fn"), "pred_entities": F.col("tp") + F.col("fp")})
    return _rated(sums, "file_name", "silver_entities", "pred_entities")


def label_metrics(compared: DataFrame) -> DataFrame:
    """Counts and rates of each label."""
    return _rated(compared.groupBy("label").agg(*_counted()), "label")


def global_metrics(compared: DataFrame, files: DataFrame) -> DataFrame:
    """Counts summed over all files, rates of the sums, and the number of files."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("silver_entities", "pred_entities", *_COUNTS)]
    summed = file_metrics(compared, files).agg(F.count("*").alias("evaluated_files"), *sums)
    return _rated(summed, "evaluated_files", "silver_entities", "pred_entities")


def metrics_all_grains(compared: DataFrame, files: DataFrame) -> DataFrame:
    """File, label and global metrics by one aggregation over grouping sets; files without entities come as rows of no status."""
    none = F.lit(None).cast("string")
    rows = compared.select("file_name", "label", "status").unionByName(files.select("file_name", none.alias("label"), none.alias("status")))
    sets = rows.groupingSets([["file_name"], ["label"], []], "file_name", "label").agg(F.grouping_id().alias("g"), *_counted())
    grain = F.when(F.col("g") == 1, "file").when(F.col("g") == 2, "label").otherwise("global")
    return _rated(sets.where("g <> 2 or tp + fp + fn > 0").withColumn("grain", grain), "grain", "file_name", "label")
