"""Generated notes: choosing the note in a model's answer, hashes, statuses and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrain.functions.text import SPACE, strip

LEAST_CHARACTERS = 80


def strip_think(text: Column, any_case: bool = True) -> Column:
    return strip(F.regexp_replace(text, f"(?{'i' if any_case else ''}s)<think>.*?</think>", ""))


def delimited(text: Column) -> Column:
    """What stands between the first pair of delimiters; null if nothing does."""
    found = strip(F.regexp_extract(text, rf"(?s)---INICIO---[{SPACE}]*(.*?)[{SPACE}]*---FIN---", 1))
    return F.when(found != "", found)


def resolve_note(content: Column, thinking: Column | None = None, provider: str = "openai") -> Column:
    """struct<note, strategy>: the first source that gives a note."""
    stripped = strip_think(content)
    whole, whole_name = (content, "full_content") if provider == "claude" else (stripped, "full_content_stripped")
    steps = [(delimited(content), "delimited_content")]
    if provider != "claude":
        steps.append((delimited(stripped), "delimited_content_stripped"))
    steps.append((F.when(F.length(whole) >= LEAST_CHARACTERS, whole), whole_name))
    if provider == "ollama" and thinking is not None:
        steps.append((delimited(thinking), "delimited_thinking"))
    chosen = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("note"), F.lit(n).alias("strategy"))) for c, n in steps])
    return F.coalesce(chosen, F.struct(F.lit("").alias("note"), F.lit("no_output").alias("strategy")))


def prompt_hash(case: Column, system: str, template: str, provider: str = "openai") -> Column:
    """SHA-1 of case, system prompt and template; one provider's hash leaves the template out."""
    return F.sha1(F.concat(case, F.lit(system), F.lit("" if provider == "ollama" else template)))


def pending(cases: DataFrame, outputs: DataFrame, provider: str = "openai", overwrite: bool = False) -> DataFrame:
    """Cases still to be generated, by the provider's rule; outputs: file_name, bytes of what exists."""
    if overwrite:
        return cases.withColumn("status", F.lit("pending"))
    there = outputs.where("bytes > 0") if provider == "ollama" else outputs
    if provider == "openai":
        marked = cases.join(there.select("file_name", F.lit(True).alias("exists")).distinct(), "file_name", "left")
        return marked.withColumn("status", F.when(F.col("exists"), "skipped_existing").otherwise("pending")).drop("exists")
    return cases.join(there, "file_name", "left_anti").withColumn("status", F.lit("pending"))


def run_log(answers: DataFrame, system: str, template: str, provider: str = "openai") -> DataFrame:
    """file_name, case, content, thinking, exists -> a log row: status, lengths, hashes."""
    case = strip(F.coalesce("case", F.lit("")))
    note = resolve_note(F.coalesce("content", F.lit("")), F.col("thinking"), provider)
    rows = answers.select("file_name", case.alias("case"), note.alias("n"), "exists")
    empty = F.length("case") == 0
    status = F.when(empty, "empty_input").when(F.col("exists"), "skipped_existing").when(F.col("n.note") == "", "empty_output").otherwise("ok")
    logged = rows.withColumn("status", status)
    called, ok = F.col("status").isin("ok", "empty_output"), F.col("status") == "ok"
    return logged.select(
        "file_name", "status", F.when(empty, 0).otherwise(F.length("case")).alias("input_chars"), F.when(ok, F.length("n.note")).otherwise(0).alias("output_chars"),
        F.when(called, prompt_hash(F.col("case"), system, template, provider)).alias("prompt_hash"), F.when(ok, F.sha1("n.note")).alias("response_hash"),
    )


def results(rows: DataFrame, model: str, system: str, template: str, provider: str = "openai") -> DataFrame:
    """input_path, output_path, case, content, thinking, status, error, latency_s -> log rows, with the note.

    Statuses are empty_input and skipped_existing as they come, ok and empty_output by what the answer holds, and what a
    failed call says.
    """
    called = ~F.col("status").isin("empty_input", "skipped_existing")
    answered = F.col("status").isin("ok", "rejected")
    note = resolve_note(F.coalesce("content", F.lit("")), F.coalesce("thinking", F.lit("")), provider)["note"]
    seen = rows.withColumn("note", F.when(answered, note).otherwise("")).withColumn("case", F.coalesce("case", F.lit("")))
    status = F.when(answered, F.when(F.col("note") == "", "empty_output").otherwise("ok")).otherwise(F.col("status"))
    return seen.select(
        "input_path", "output_path", status.alias("status"), F.when(status == "ok", "").otherwise(F.coalesce("error", F.lit(""))).alias("error"), F.coalesce("latency_s", F.lit(0.0)).alias("latency_s"),
        F.length("case").alias("input_chars"), F.length("note").alias("output_chars"), F.lit(model).alias("model"), F.when(called, prompt_hash(F.col("case"), system, template, provider)).otherwise("").alias("prompt_hash"),
        F.when(F.col("note") != "", F.sha1("note")).otherwise("").alias("response_hash"), "note", "raw",
    )


def note_files(done: DataFrame, folder: str) -> DataFrame:
    """file_name (below the folder), content of the notes that came out well."""
    name = F.substring("output_path", len(folder.rstrip("/")) + 2, 1 << 20)
    return done.where("status = 'ok'").select(name.alias("file_name"), F.concat(strip(F.col("note")), F.lit("\n")).alias("content"))


def error_files(done: DataFrame) -> DataFrame:
    """file_name (in _errors), content of a record for each call without a note."""
    base = F.regexp_replace(F.element_at(F.split("input_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.concat(F.lit("_errors/"), base, F.lit("."), "status", F.lit(".error.json"))
    record = F.struct("input_path", "output_path", "status", "error", "model", "latency_s", "input_chars", F.col("raw").alias("raw_json"))
    failed = done.where(~F.col("status").isin("ok", "empty_input", "skipped_existing"))
    return failed.select(name.alias("file_name"), F.concat(F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n")).alias("content"))


def log_rows(done: DataFrame) -> DataFrame:
    """The run's log: seconds with three decimals, no notes."""
    return done.drop("note", "raw").withColumn("latency_s", F.format_string("%.3f", "latency_s")).orderBy("input_path")
