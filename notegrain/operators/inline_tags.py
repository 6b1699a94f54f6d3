"""Inline tags to plain text with spans, and back.

Reading: tags cut a text into pieces whose decoded lengths give every tag's place in the plain text. Tags of one label
are a walk of +1 and -1; a close that takes the walk to a new least value below zero has no opening, any other pairs with
the last event of its level. So with a document's tags in the order of label, level and place, pairs are neighbours.
All of it happens in an array beside the text: nothing is shuffled. A tag with no pair, and a "<" that begins no tag,
are counted.

Writing: each span makes an opening and a closing event; the text between event places and the events, in order, make
the tagged text of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrain.functions.text import escape, label_priority, let, running_totals, sanitize_tag, unescape

TAG = r"<(/?)([A-Za-z0-9_:-]+)>"
#: Tags that the walk takes at a time.
_RUN = 128
_EVENTS = "array<struct<label:string,level:int,k:int,close:boolean,place:int>>"


def _tagged() -> Column:
    return F.coalesce(F.col("tagged"), F.lit(""))


def _pieces(tagged: Column) -> Column:
    """The text between tags, decoded."""
    return F.transform(F.split(tagged, TAG, -1), unescape)


def _tags(tagged: Column) -> Column:
    """array<struct<label, k, close, place>>, by label and k: each tag, and its place in the plain text."""
    parts = F.struct(
        F.regexp_extract_all(tagged, F.lit(TAG), F.lit(1)).alias("slash"),
        F.regexp_extract_all(tagged, F.lit(TAG), F.lit(2)).alias("label"),
        running_totals(F.transform(_pieces(tagged), F.length)).alias("places"),
    )

    def one(p: Column) -> Column:
        return F.transform(p["label"], lambda name, k: F.struct(name.alias("label"), k.alias("k"), (F.get(p["slash"], k) == "/").alias("close"), F.get(p["places"], k).alias("place")))

    return F.array_sort(let(parts, one))


def _step(state: Column, tag: Column) -> Column:
    """One tag on: where its label's walk stands, and the tag with its level (-1: a close without an opening)."""
    fresh = ~state["label"].eqNullSafe(tag["label"])
    now = F.when(fresh, 0).otherwise(state["now"]) + F.when(tag["close"], -1).otherwise(1)
    low = F.when(fresh, 0).otherwise(state["low"])
    depth = now - low

    def on(v: Column) -> Column:
        level = F.when(tag["close"] & (v["depth"] < 0), -1).when(tag["close"], v["depth"] + 1).otherwise(v["depth"])
        event = F.struct(tag["label"].alias("label"), level.alias("level"), tag["k"].alias("k"), tag["close"].alias("close"), tag["place"].alias("place"))
        return F.struct(tag["label"].alias("label"), v["now"].alias("now"), F.least(v["low"], v["now"]).alias("low"), F.concat(state["out"], F.array(event)).alias("out"))

    return let(F.struct(now.alias("now"), low.alias("low"), depth.alias("depth")), on)


def _events(tags: Column) -> Column:
    """Tags with their levels, by label, level and k; runs of tags are walked by themselves, so long arrays stay near linear."""
    none = F.array().cast(_EVENTS)
    start = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("now"), F.lit(0).alias("low"), none.alias("out"))

    def more(state: Column, run: Column) -> Column:
        own = F.struct(state["label"].alias("label"), state["now"].alias("now"), state["low"].alias("low"), none.alias("out"))
        return let(F.aggregate(run, own, _step), lambda r: F.struct(r["label"].alias("label"), r["now"].alias("now"), r["low"].alias("low"), F.concat(state["out"], r["out"]).alias("out")))

    def walked(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / F.lit(_RUN)).cast("int")), lambda k: F.slice(t, k * _RUN + 1, _RUN))
        return F.aggregate(runs, start, more)["out"]

    return let(tags, lambda t: F.when(F.size(t) > 0, F.array_sort(walked(t))).otherwise(none))


def plain_text(docs: DataFrame) -> DataFrame:
    """doc_id, plain: tags away, entities decoded."""
    return docs.select("doc_id", F.array_join(_pieces(_tagged()), "").alias("plain"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, label, start, end, text of each matched pair that encloses text."""

    def found(v: Column) -> Column:
        # a matched close stands right after the opening of its level
        opening = lambda i: F.get(v["events"], i - 1)["place"]
        closes = F.transform(v["events"], lambda x, i: F.struct(x["label"].alias("label"), F.when(x["close"] & (x["level"] >= 0), opening(i)).alias("start"), x["place"].alias("end")))
        enclosing = F.filter(closes, lambda x: x["end"] > x["start"])
        return F.transform(enclosing, lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"), F.substring(v["plain"], x["start"] + 1, x["end"] - x["start"]).alias("text")))

    both = F.struct(_events(_tags(_tagged())).alias("events"), F.array_join(_pieces(_tagged()), "").alias("plain"))
    return docs.select("doc_id", F.explode(let(both, found)).alias("s")).select("doc_id", "s.*")


def stats(docs: DataFrame) -> DataFrame:
    """doc_id, malformed_tag_starts, unmatched_closing_tags, unclosed_open_tags of every document."""

    def counts(events: Column) -> Column:
        def unclosed(x: Column, i: Column) -> Column:
            after = F.get(events, i + 1)
            return ~x["close"] & ~(after["label"].eqNullSafe(x["label"]) & after["level"].eqNullSafe(x["level"]))

        lost = F.size(F.filter(events, lambda x: x["level"] == -1))
        return F.struct(lost.cast("long").alias("unmatched_closing_tags"), F.size(F.filter(events, unclosed)).cast("long").alias("unclosed_open_tags"))

    opens = F.length(_tagged()) - F.length(F.replace(_tagged(), F.lit("<"), F.lit("")))
    malformed = (opens - F.regexp_count(_tagged(), F.lit(TAG))).cast("long").alias("malformed_tag_starts")
    return docs.select("doc_id", malformed, let(_events(_tags(_tagged())), counts).alias("c")).select("doc_id", "malformed_tag_starts", "c.*")


def tag(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id, text and doc_id, label, start, end -> doc_id, tagged.

    At a place closes come first (later starts first), then opens (later ends first), each then by priority and label;
    events beyond the text's end are dropped.
    """
    name, priority = sanitize_tag(F.col("label")), label_priority(F.col("label"))
    opened = F.struct(F.col("start").alias("place"), F.lit(1).alias("kind"), (-F.col("end")).alias("far"), priority.alias("priority"), F.col("label"), F.concat(F.lit("<"), name, F.lit(">")).alias("mark"))
    closed = F.struct(F.col("end").alias("place"), F.lit(0).alias("kind"), (-F.col("start")).alias("far"), priority.alias("priority"), F.col("label"), F.concat(F.lit("</"), name, F.lit(">")).alias("mark"))
    events = annotations.select("doc_id", F.explode(F.array(opened, closed)).alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    none = F.array().cast("array<struct<place:int,kind:int,far:int,priority:int,label:string,mark:string>>")
    joined = docs.select("doc_id", "text").join(events, "doc_id", "left")
    within = F.filter(F.coalesce("events", none), lambda e: e["place"] <= F.length("text"))

    def written(v: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            before = F.coalesce(F.get(v["events"], i - 1)["place"], F.lit(0))
            return F.concat(escape(F.substring(v["text"], before + 1, e["place"] - before)), e["mark"])

        last = F.coalesce(F.get(v["events"], F.size(v["events"]) - 1)["place"], F.lit(0))
        return F.concat(F.array_join(F.transform(v["events"], piece), ""), escape(F.substring(v["text"], last + 1, F.length(v["text"]))))

    return joined.select("doc_id", let(F.struct(within.alias("events"), F.col("text")), written).alias("tagged"))
