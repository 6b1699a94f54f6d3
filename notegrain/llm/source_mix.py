"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sizes are words. The mix holds SHARE times the words of all sources. A source's target is the least of its cap
(EPOCHS times its size) and its weight times one common level; the level at which the targets fill the mix is where
clamping at the cap and resharing the excess by weight comes to rest. With the sources in order of cap by weight, the
level is found from running sums: the first source that isn't clamped fixes it (clamping more of them only lowers it, so
it is the highest level at which the source at hand stays below its cap).

A source at target = r times its size takes floor(r) whole repetitions of every document and one more of a seeded
choice of documents whose words come to the rest. Documents stand in the order of a seeded hash of doc_id and are
chosen up to the point nearest the rest, so a source misses its target by at most half a document. Running sums are
taken in two steps, so that a source that holds most of the rows is never in one task: sums of CELLS cells of the hash
by source, then rows within the one cell where the choice ends.

Defined results: null text has size 0; null source is a source, the last; rows with equal doc_id in a source are taken
alike (so are rows with null doc_id and equal text); targets of empty sources are 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrain.llm._common import WORD_PATTERN, checkpoint, table

WEIGHTS = (3, 1, 2)
SHARE_NUMERATOR, SHARE_DENOMINATOR = 3, 2
EPOCHS = 2
SEED = "mix"
#: Cells of the hash in each source.
CELLS = 4096
#: Sources whose limits are broadcast at most; more of them are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded_place(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of a seeded MD5 of the id (where null, of the text): the order in which documents are chosen."""
    digits = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("long").cast("string"), text.cast("string"))))
    return F.conv(F.substring(digits, 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> and target. A row for each source; nulls last."""
    everyone = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    total = F.sum("source_size").over(everyone) * SHARE_NUMERATOR / F.lit(float(SHARE_DENOMINATOR))
    capped = sources.withColumn("weight", weight).withColumn("total", total).withColumn("cap", F.col("source_size") * EPOCHS)
    order = everyone.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    clamped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level_here", (F.col("total") - clamped) / open_weight)
    level = F.max(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.col("level_here"))).over(everyone)
    reached = levels.withColumn("level", level)
    full = F.col("cap").cast("double")
    return reached.select("source", "source_size", F.when(F.col("level").isNull(), full).otherwise(F.least(F.col("level") * F.col("weight"), full)).alias("target"))


def _join_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on source, nulls as equals. right has a row for each source and is broadcast if those are few."""
    renamed = right.withColumnRenamed("source", "other source")
    if right.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        renamed = F.broadcast(renamed)
    return left.join(renamed, F.col("source").eqNullSafe(F.col("other source")), "left").drop("other source")


def limits(rows: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cutoff from rows of source, size, place.

    Every document of a source is taken whole times, and once more if its place is at most the cutoff.
    """
    width = (1 << 48) // CELLS
    rows = rows.withColumn("cell", F.floor(F.col("place") / F.lit(width)).cast("int"))
    cells = checkpoint(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    aims = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    aims = checkpoint(aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")
    # the cell in which a source's running sum reaches what it still wants
    ends = _join_source(cells.withColumn("before", before), aims).where("rest > before and rest <= before + cell_size")
    ends = ends.groupBy("source").agg(F.min(F.struct("cell", "before", "rest")).alias("e")).select("source", "e.cell", "e.before", "e.rest")
    ends = checkpoint(ends.withColumnRenamed("cell", "end_cell"))
    # only places of the last cells are put in order
    places = _join_source(rows, ends).where("cell = end_cell").groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("place")) + F.col("before")
    under, over = F.col("rest") - (F.col("upto") - F.col("size")), F.col("upto") - F.col("rest")
    chosen = places.withColumn("upto", upto).where((F.col("upto") <= F.col("rest")) | (under > 0) & (over < under))
    last = checkpoint(chosen.groupBy("source").agg(F.max("place").alias("place")))
    cutoff = F.coalesce("place", F.col("end_cell") * F.lit(width) - 1, F.lit(-1)).alias("cutoff")
    return checkpoint(_join_source(_join_source(aims, ends.select("source", "end_cell")), last).select("source", "source_size", "target", "whole", cutoff))


def _reps() -> Column:
    return F.col("whole") + (F.col("place") <= F.col("cutoff")).cast("int")


def _light(docs: DataFrame) -> DataFrame:
    identity = (F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    return checkpoint(docs.select(*identity, word_count(F.col("text")).alias("size"), seeded_place(F.col("doc_id"), F.col("text")).alias("place")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row."""
    rows = _light(docs)
    return _join_source(rows, limits(rows)).select("doc_id", "source", "size", "source_size", "target", (_reps() * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The documents' rows, each as often as the mix takes it. Texts aren't moved: the sources' limits come to them.

    Null source is a source, rows that tie in place are taken alike, an empty table stays empty with its columns.
    """
    names = [f"column {k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    column = dict(zip(docs.columns, names, strict=True))
    keyed = plain.withColumn("source", F.col(column["source"]).cast("string")).withColumn("place", seeded_place(F.col(column["doc_id"]), F.col(column["text"])))
    taken = _join_source(keyed, limits(_light(docs))).withColumn("reps", _reps()).where("reps > 0")
    return taken.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("reps")))).select(*names).toDF(*docs.columns)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of the whole documents table; see the module for nulls, ties and empty tables."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || doc_id::varchar), 1, 12))::bigint as place
  from documents),
src as (select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sized group by source),
capped as (select *, source_size * 2 as cap, (sum(source_size) over ()) * 3 / 2.0::double as total from src),
levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
            / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::double as here
  from capped),
level as (select *, max(case when here * weight <= cap then here end) over () as lv from levels),
aims as (select source, source_size, case when lv is null then cap::double else least(lv * weight, cap::double) end as target from level),
parts as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from aims),
places as (
  select d.source, d.place, sum(d.size)::bigint as size, any_value(p.target - p.whole * p.source_size) as rest
  from sized d join parts p on d.source is not distinct from p.source group by d.source, d.place),
running as (select *, sum(size) over (partition by source order by place)::bigint as upto from places),
chosen as (select source, max(place) as cutoff from running
  where rest > 0 and (upto <= rest or (rest - (upto - size) > 0 and upto - rest < rest - (upto - size))) group by source)
select d.doc_id, d.source, d.size, p.source_size, p.target,
       ((p.whole + case when d.place <= c.cutoff then 1 else 0 end) * d.size)::bigint as taken
from sized d join parts p on d.source is not distinct from p.source left join chosen c on d.source is not distinct from c.source
"""
