"""Documents through token classifiers, end to end, and what comes of it by document.

Documents are normalised and cut into overlapping chunks; every model sees every chunk; tokens become spans with places
in the document; spans outside the score band go; spans of one label that share a bound are folded, chunk by chunk and
then over the document; equal mentions of several models are one, the first model's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrain.functions.text import normalize_text
from notegrain.operators import dedup, services, tokens


@dataclass(frozen=True)
class Workflow:
    """Models by name, and how their tokens are put together."""

    models: Mapping[str, Callable[[], services.TokenClassifier]]
    average: bool = True
    batch: int = 16
    low: float = 0.85
    high: float = 1.0
    chunk: int = 40_000
    overlap: int = 2_000
    stride: int = 192
    most_windows: int = 2_000


def extract(docs: DataFrame, flow: Workflow, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """doc_id, text -> mentions (doc_id, model, label, start, end, score, text), and errors (doc_id, model, error).

    A model that fails on a chunk of a document has no mentions in that document, and an error. Models aren't
    deterministic, so their tokens are kept (persisted, checkpointed) before they are used twice.
    """
    texts = docs.select("doc_id", normalize_text(F.col("text")).alias("text")).where("text <> ''")
    chunks = tokens.chunk_texts(texts, flow.chunk, flow.overlap)
    scored = keep(services.classify_chunks(chunks, flow.models, flow.batch, flow.most_windows))
    errors = scored.where("error is not null").groupBy("doc_id", "model").agg(F.min_by("error", "window_id").alias("error"))
    good = scored.where("error is null").join(errors.select("doc_id", "model"), ["doc_id", "model"], "left_anti")
    spans = tokens.bio_spans(good, texts, flow.average, flow.low, flow.high)
    in_chunk = spans.withColumn("chunk", F.floor(F.col("window_id") / F.lit(flow.most_windows))).withColumn("arrival", F.struct("window_id", "start", "end"))
    folded = dedup.by_span_and_label(in_chunk, "doc_id", "model", "chunk", carried=("text", "score")).withColumn("arrival", F.struct("chunk", "start", "end", "label"))
    whole = dedup.by_span_and_label(folded, "doc_id", "model", carried=("text", "score"))
    order = F.array_position(F.array(*map(F.lit, flow.models)), F.col("model"))
    once = dedup.exact(whole.withColumn("arrival", F.struct(order.alias("k"), "start", "end", "label")), "doc_id")
    return once.select("doc_id", "model", "label", "start", "end", "score", "text"), errors


def patient_records(docs: DataFrame, mentions: DataFrame, errors: DataFrame, flow: Workflow) -> DataFrame:
    """doc_id, file_name, json: a record for each document of docs (doc_id, patient_id, age, file_name), with its entities in order."""
    entity = F.struct("start", "end", "model", "label", "text", "score")
    grouped = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(entity)).alias("found"))
    failed = errors.groupBy("doc_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    rows = docs.join(grouped, "doc_id", "left").join(failed, "doc_id", "left")
    shown = F.transform("found", lambda e: F.struct(*[e[c].alias(c) for c in ("text", "label", "score", "start", "end", "model")]))
    empty = F.array().cast("array<struct<text:string,label:string,score:double,start:int,end:int,model:string>>")
    settings = {"min_score": flow.low, "max_score": flow.high, "batch_windows": flow.batch, "window_stride_tokens": flow.stride, "ner_char_chunk_size": flow.chunk, "ner_char_chunk_overlap": flow.overlap}
    record = F.struct(
        "patient_id", "age", "file_name", F.array(*map(F.lit, flow.models)).alias("models"), *[F.lit(v).alias(k) for k, v in settings.items()], F.coalesce(F.size("found"), F.lit(0)).alias("num_entities"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), F.coalesce(shown, empty).alias("entities"),
    )
    name = F.concat(F.lit("patient_"), F.col("patient_id").cast("string"), F.lit(".json"))
    return rows.select("doc_id", name.alias("file_name"), F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def mention_table(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """The flat table of mentions: patient_id, age, file_name, model, label, entity_text, score, start, end."""
    return docs.select("doc_id", "patient_id", "age", "file_name").join(mentions, "doc_id").select("patient_id", "age", "file_name", "model", "label", F.col("text").alias("entity_text"), "score", "start", "end")
