"""Whole runs over folders: generate, judge, tag, untag, extract, evaluate. Each gives its counts.

Inputs are read and outputs written by executors, so folders must be within their reach. Tables are written as folders of
CSV or JSON part files; notes, annotations and records are files of their own names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from notegrain.operators import dedup, extraction, generation, inline_tags, judging, matching, mentions, services, standoff
from notegrain.sources import files


#: Names of notes that a summary shows.
SAMPLE_FILES = 10


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """Rows as they are, counted as they pass; read the counts after an action."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """list_files, of a folder that need not be there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file_path string, file_name string, bytes long")
    return files.list_files(spark, folder)


def generate(spark: SparkSession, source: str, target: str, config: files.ServiceConfig, factory: Callable[[files.ServiceConfig], services.Client], system: str, template: str, overwrite: bool = False, log: str | None = None) -> dict[str, int]:
    """A note for each case below source, at the same place below target; failures as records in _errors; a log.

    What is there already is left alone, by the provider's rule: any file, or one that isn't empty; one provider logs it.
    """
    base, goal = files.qualified(spark, source), files.qualified(spark, target)
    path = F.col("file_path")
    cases = files.read_files(spark, source, lossy=True).select(path.alias("input_path"), files.output_path(files.relative_path(path, base), goal).alias("output_path"), files.strip(F.col("text")).alias("case"))
    there = _listed(spark, target).where("bytes > 0" if config.provider == "ollama" else "true").select(F.col("file_path").alias("output_path"), F.lit(True).alias("exists"))
    marked = cases.join(there, "output_path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)) & F.lit(not overwrite))
    if config.provider in ("claude", "ollama"):
        marked = marked.where(~F.col("exists"))
    state = F.when(F.col("case") == "", "empty_input").when(F.col("exists"), "skipped_existing")
    keep = files.staged(target)
    marked = keep(marked.withColumn("state", state))
    asked = marked.where("state is null").select(F.col("input_path").alias("file_name"), "case")
    answers = services.call(asked, config, factory, system, template).drop("case").withColumnRenamed("file_name", "input_path")
    joined = marked.join(answers, "input_path", "left")
    error = F.when(F.col("state") == "empty_input", "Input .txt is empty after strip().").otherwise(F.col("error"))
    rows = joined.withColumn("error", error).withColumn("status", F.coalesce("state", "status"))
    done = keep(generation.results(rows, config.model, system, template, config.provider))
    counts = {r.status: r["count"] for r in done.groupBy("status").count().collect()}
    if counts or config.provider != "claude":
        files.write_files(generation.note_files(done, goal).unionByName(generation.error_files(done)), target)
        files.write_csv(generation.log_rows(done), log or f"{target.rstrip('/')}/log.csv", quote_all=True)
    files.drop_staged(spark, target)
    return counts


def judged(notes: DataFrame, completed: DataFrame, config: files.ServiceConfig, factory: Callable[[files.ServiceConfig], services.Client], system: str, template: str, keep: Callable[[DataFrame], DataFrame], mark: str = "{generated_note}") -> DataFrame:
    """strategy, file_name, relative_path, file_path, text of notes -> also raw_text, raw, status (ok: a valid answer), error.

    Of notes of one name the first is judged first; another one only if those before it failed. The driver steps through
    the turns, of which there are as many as the most common name has notes. Each turn's answers are kept (see staged).
    """
    ranked = keep(judging.pending(notes, completed))
    last = ranked.agg(F.max("turn")).first()
    out: DataFrame | None = None
    for turn in range(1, (last[0] or 0) + 1 if last else 1):
        now = ranked.where(F.col("turn") == turn)
        if out is not None:
            now = now.join(out.where("status = 'ok'").select("file_name").distinct(), "file_name", "left_anti")
        answers = services.call(now.select("file_name", F.col("text").alias("case")), config, factory, system, template, mark, judging.complete_answer)
        found = keep(now.join(answers.select("file_name", F.col("content").alias("raw_text"), "raw", "status", "error"), "file_name"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return ranked.select("*", *[F.lit(None).cast("string").alias(c) for c in ("raw_text", "raw", "status", "error")])
    return out


def judge(spark: SparkSession, source: str, target: str, config: files.ServiceConfig, factory: Callable[[files.ServiceConfig], services.Client], system: str, template: str, debug: bool = False) -> dict[str, object]:
    """Scores of notes below source into target: results.jsonl, results.csv, parse_errors.jsonl, and debug.jsonl if asked for.

    Notes whose name either log has valid scores of aren't judged again. A log that is one file becomes a folder's first part.
    """
    out = target.rstrip("/")
    keep = files.staged(target)
    for name in ("results.jsonl", "results.csv", "parse_errors.jsonl", "debug.jsonl"):
        files.as_folder(spark, f"{out}/{name}")
    completed = keep(files.completed_names(spark, f"{out}/results.jsonl", f"{out}/results.csv"))
    found = files.discover_notes(spark, source, target)
    texts = files.read_files(spark, source, lossy=True).select("file_path", files.strip(F.col("text")).alias("text"))
    notes = keep(found.join(texts, "file_path"))
    done = judged(notes, completed, config, factory, system, template, keep)
    good, bad = done.where("status = 'ok'"), done.where("status <> 'ok'")
    files.append_json(judging.success_records(good, config.model, config.provider), f"{out}/results.jsonl")
    files.append_json(judging.error_records(bad, config.model, config.provider), f"{out}/parse_errors.jsonl")
    files.append_csv(judging.flat_rows(good, config.model, config.provider).drop("parse_error"), f"{out}/results.csv")
    if debug:
        known = judging.error_records(good, config.model, config.provider).drop("parse_error").columns
        shown = good.select("*", F.col("file_name").alias("filename"), F.col("file_path").alias("filepath"), F.lit(config.model).alias("model"), F.lit(config.provider).alias("provider"))
        files.append_json(shown.select(*known, "raw_text", F.col("raw").alias("raw_response")), f"{out}/debug.jsonl")
    n, sample = notes.count(), [r.relative_path for r in notes.orderBy("strategy", "relative_path").limit(SAMPLE_FILES).collect()]
    counts = {r.status: r["count"] for r in done.groupBy("status").count().collect()}
    ok = counts.pop("ok", 0)
    errors = sum(counts.values())
    files.drop_staged(spark, target)
    return {"found": n, "processed": ok, "errors": errors, "skipped": n - ok - errors, "sample": sample}


def tag(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Texts with annotations of the same stem right in source -> tagged texts in target."""
    found = files.pairs(spark, source)
    lines = found.select(F.col("stem").alias("file_name"), F.explode(F.split("ann", "\n")).alias("line"))
    spans = standoff.parse_spans(lines).withColumnRenamed("file_name", "doc_id")
    tagged = inline_tags.tag(found.select(F.col("stem").alias("doc_id"), "text"), spans)
    return {"files": files.write_files(tagged.select(files.tagged_name(F.col("doc_id")).alias("file_name"), F.col("tagged").alias("content")), target)}


def untag(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Tagged texts right in source -> plain texts and annotations in target; counts of what didn't pair."""
    read = files.read_files(spark, source, recursive=False)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    docs = read.select(files.restored_name(stem).alias("doc_id"), F.col("text").alias("tagged")).persist()
    lines = standoff.ann_lines(inline_tags.spans(docs).withColumnRenamed("doc_id", "file_name"), clean_label=False)
    content = standoff.ann_documents(lines, docs.select(F.col("doc_id").alias("file_name")))
    named = lambda df, ending, column: df.select(F.concat(df[df.columns[0]], F.lit(ending)).alias("file_name"), F.col(column).alias("content"))
    written = files.write_files(named(inline_tags.plain_text(docs), ".txt", "plain").unionByName(named(content, ".ann", "content")), target)
    sums = inline_tags.stats(docs).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("malformed_tag_starts", "unmatched_closing_tags", "unclosed_open_tags")]).first()
    return {"files": written, **(sums.asDict() if sums else {})}


def _per_file(found: DataFrame, docs: DataFrame) -> DataFrame:
    """A mention table: file_name and file_path first, then what the operator gives."""
    return docs.select("doc_id", "file_name", "file_path").join(found, "doc_id").drop("doc_id").orderBy("file_path", "match_index")


def extract(spark: SparkSession, source: str, target: str, flows: Mapping[str, extraction.Workflow]) -> dict[str, int]:
    """Mentions of models, Gleason scores and PSA values in the notes below source -> tables and annotations in target.

    target gets an .ann for each note, of all mentions merged; below etiquetas each workflow's table, and records of its
    documents. Notes of one name share an .ann, the last one's; notes below target aren't read.
    """
    out = target.rstrip("/")
    keep = files.staged(target)
    docs = keep(files.read_notes(spark, source, target).withColumn("doc_id", F.col("patient_id")).withColumn("age", F.lit(None).cast("int")))
    sources = []
    for name, flow in flows.items():
        found, errors = extraction.extract(docs, flow, keep)
        found = keep(found)
        files.write_csv(extraction.mention_table(docs, found), f"{out}/etiquetas/{name}/menciones_ner_{name}.csv")
        records = extraction.patient_records(docs, found, errors, flow)
        files.write_files(records.select(F.concat(F.lit("json_por_paciente/"), "file_name").alias("file_name"), F.col("json").alias("content")), f"{out}/etiquetas/{name}")
        sources.append(found)
    for name, operator in (("gleason", mentions.gleason_mentions), ("psa", mentions.psa_mentions)):
        found = keep(operator(docs))
        files.write_csv(_per_file(found, docs), f"{out}/etiquetas/{name}/{name}_mentions_simple.csv")
        sources.append(found)
    place = Window.partitionBy("file_name").orderBy("start", "end", "label", "text")
    light = [s.select(F.col("doc_id").alias("file_name"), "label", "start", "end", "text").withColumn("arrival", F.row_number().over(place).cast("long")) for s in sources]
    merged = dedup.merged(docs.select(F.col("doc_id").alias("file_name")), light).where("label is not null")
    content = standoff.ann_documents(standoff.ann_lines(merged), docs.select(F.col("doc_id").alias("file_name")))
    files.clear_files(target)
    named = content.withColumnRenamed("file_name", "doc_id").join(docs.select("doc_id", F.col("file_name").alias("note")), "doc_id")
    written = files.write_files(named.select(F.concat(F.regexp_replace("note", r"(?<=.)\.[^.]*$", ""), F.lit(".ann")).alias("file_name"), "content"), target)
    counted, seen = observed(merged)
    counted.write.format("noop").mode("overwrite").save()
    files.drop_staged(spark, target)
    return {"files": written, "mentions": seen.get["rows"]}


def evaluate(spark: SparkSession, silver: str, predicted: str, target: str, normalize: bool = True, case_sensitive: bool = False) -> dict[str, object]:
    """Annotations of two folders compared, file by file of one name: four tables in target, and the global row."""
    out = target.rstrip("/")
    sides = {folder: standoff.parse_lines(files.ann_file_lines(spark, folder), case_sensitive, normalize) for folder in (silver, predicted)}
    names = {folder: files.list_files(spark, folder, "*.ann", recursive=False) for folder in (silver, predicted)}
    common = matching.paired_files(names[silver], names[predicted]).persist()
    compared = matching.comparisons(sides[silver], sides[predicted], common).persist()
    present = [F.lit(1).alias("silver_file_present"), F.lit(1).alias("pred_file_present")]
    per_file = matching.file_metrics(compared, common).select("file_name", *present, "silver_entities", "pred_entities", "tp", "fp", "fn", "precision", "recall", "f1_score", "accuracy")
    whole = matching.global_metrics(compared, common).select(F.lit(silver).alias("silver_dir"), F.lit(predicted).alias("pred_dir"), "*", F.lit("same_label_and_same_start_or_end").alias("tp_rule"))
    tables = {"detailed_entity_comparisons": matching.in_report_order(compared), "file_level_metrics": per_file.orderBy("file_name"), "label_level_metrics": matching.label_metrics(compared).orderBy("label"), "global_metrics": whole}
    for name, table in tables.items():
        files.write_csv(table, f"{out}/{name}.csv")
    row = whole.first()
    return row.asDict() if row else {}
