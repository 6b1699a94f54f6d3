"""Decoding token predictions into spans, and cutting documents into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrain.functions.text import collapse

#: Fixed value: characters that may stand between tokens of one span.
GLUE = "^[\\s\\-\u2010\u2011\u2012\u2013\u2014/,;:.()]+$"


def bio_spans(tokens: DataFrame, texts: DataFrame, average: bool, low: float | None = None, high: float | None = None) -> DataFrame:
    """Tokens (doc_id, model, window_id, idx, st, en, label, score) and texts (doc_id, text) -> spans.

    Gaps and islands: a token goes on with the span of the effective token before it if it has the same type and
    touches it, overlaps it, or only glue lies between. O and special tokens end a span; tokens without length are passed
    over. Scores are averaged or the least is taken; spans outside the score band go.

    Tokens are dealt by document, without texts. What touches or overlaps is put together first; the text comes once, to
    the runs of such parts that only glue could hold together, and is read between parts.
    """
    keys = ["doc_id", "model", "window_id"]
    special = F.col("st").isNull() | F.col("en").isNull() | ((F.col("st") == 0) & (F.col("en") == 0))
    rows = tokens.select(*keys, "idx", "st", "en", "label", "score", special.alias("special")).where((F.col("special") & (F.col("idx") > 0)) | (~F.col("special") & (F.col("en") > F.col("st"))))
    kind = F.when(F.col("special") | (F.col("label") == "O"), F.lit(None)).when(F.col("label").contains("-"), F.regexp_extract("label", r"^[^-]*-(.*)$", 1)).otherwise(F.col("label"))
    prefix = F.when(F.col("label").contains("-"), F.upper(F.regexp_extract("label", r"^([^-]*)-", 1))).otherwise("B")
    order = Window.partitionBy(*keys).orderBy("idx")
    light = rows.select(*keys, "idx", "st", "en", "score", kind.alias("kind"), prefix.isin("B", "I").alias("near")).repartition("doc_id")
    seen = light.withColumn("last_en", F.lag("en").over(order)).withColumn("same", F.coalesce(F.col("kind") == F.lag("kind").over(order), F.lit(False)))
    joins = F.col("same") & ((F.col("st") == F.col("last_en")) | F.col("near") & (F.col("st") < F.col("last_en")))
    may_join = F.col("same") & F.col("near") & (F.col("st") > F.col("last_en"))
    count = lambda c: F.sum(F.when(c, 0).otherwise(1)).over(order)
    numbered = seen.select("*", F.coalesce(joins, F.lit(False)).alias("joins"), count(joins).alias("part"), count(joins | may_join).alias("run")).where("kind is not null")
    # only a part's first token doesn't join; what lies before it is the gap. A run is of one kind
    before, after = (F.max(F.when(~F.col("joins"), F.col(c))).alias(n) for c, n in (("last_en", "gap_st"), ("st", "gap_en")))
    parts = numbered.groupBy(*keys, "run", "part", "kind").agg(before, after, F.min("st").alias("st"), F.max("en").alias("en"), F.sum("score").alias("total"), F.count("*").alias("n"), F.min("score").alias("least"))
    item = F.struct("part", "gap_st", "gap_en", "st", "en", "total", "n", "least")
    runs = parts.groupBy(*keys, "run", "kind").agg(F.array_sort(F.collect_list(item)).alias("parts"))
    joined = runs.join(texts.select("doc_id", "text"), "doc_id")

    def glued(spans: Column, x: Column) -> Column:
        last, size = F.element_at(spans, -1), F.size(spans)
        between = F.substring(F.col("text"), x["gap_st"] + 1, x["gap_en"] - x["gap_st"])
        whole = F.struct(
            F.least(last["st"], x["st"]).alias("st"), F.greatest(last["en"], x["en"]).alias("en"), (last["total"] + x["total"]).alias("total"), (last["n"] + x["n"]).alias("n"), F.least(last["least"], x["least"]).alias("least")
        )
        alone = F.struct(*[x[c].alias(c) for c in ("st", "en", "total", "n", "least")])
        return F.when((size > 0) & between.rlike(GLUE), F.concat(F.slice(spans, 1, size - 1), F.array(whole))).otherwise(F.concat(spans, F.array(alone)))

    none = F.array().cast("array<struct<st:int,en:int,total:double,n:bigint,least:double>>")
    spans = joined.select(*keys, "kind", "text", F.explode(F.aggregate("parts", none, glued)).alias("s"))
    score = F.col("s.total") / F.col("s.n") if average else F.col("s.least")
    text = collapse(F.substring(F.col("text"), F.col("s.st") + 1, F.col("s.en") - F.col("s.st")))
    named = spans.select(*keys, F.col("kind").alias("label"), F.col("s.st").alias("start"), F.col("s.en").alias("end"), score.alias("score"), text.alias("text"))
    if low is not None and high is not None:
        named = named.where(F.col("score").between(low, high))
    return named.where("text <> ''")


def _chunked(docs: DataFrame, size: int, overlap: int, *carried: str) -> DataFrame:
    """doc_id, carried, chunk, start, end: windows over each text's characters."""
    n = F.length(F.coalesce("text", F.lit("")))
    if size <= 0:
        return docs.select("doc_id", *carried, F.lit(0).alias("chunk"), F.lit(0).alias("start"), n.alias("end"))
    step = max(1, size - max(0, overlap))
    # the last window is the first one that reaches the end
    last = F.greatest(F.ceil((n - size) / F.lit(float(step))), F.lit(0)).cast("int")
    rows = docs.select("doc_id", *carried, n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select("doc_id", *carried, "chunk", (F.col("chunk") * step).alias("start"), F.least(F.col("chunk") * step + size, F.col("n")).alias("end"))


def char_chunks(docs: DataFrame, size: int = 40_000, overlap: int = 2_000) -> DataFrame:
    """doc_id, text -> chunk, start, end: windows that overlap; an empty text has one empty chunk."""
    return _chunked(docs, size, overlap)


def chunk_texts(docs: DataFrame, size: int = 40_000, overlap: int = 2_000) -> DataFrame:
    """doc_id, chunk, start, text: the windows with their texts."""
    rows = _chunked(docs, size, overlap, "text")
    return rows.select("doc_id", "chunk", "start", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
