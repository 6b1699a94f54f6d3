"""Reading notes, annotations, judge outputs and configuration; writing them. Files are read by Spark, not by the driver."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.functions.text import strip
from notegrain.operators.judging import valid_note_names


def decoded(content: Column, lossy: bool = False) -> Column:
    """Bytes as UTF-8, else as Latin-1 (or, if lossy, with replacement marks); line ends as line feeds."""
    other = F.make_valid_utf8(content.cast("string")) if lossy else F.decode(content, "ISO-8859-1")
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(other)
    return F.regexp_replace(text, "\r\n?", "\n")


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _binary(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)


def _empty(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path of the files without a byte, which the reader passes over; the reader's own list of names has them."""
    # names come as URIs, paths as they are, with one slash before a local root
    names = [(re.sub("^file:/+", "file:/", unquote(n)),) for n in files.inputFiles()]
    return spark.createDataFrame(names, "path string").join(files.select("path"), "path", "left_anti")


def read_files(spark: SparkSession, folder: str, pattern: str = "*.[tT][xX][tT]", recursive: bool = True, lossy: bool = False) -> DataFrame:
    """file_path, file_name, text of the files below a folder."""
    files = _binary(spark, folder, pattern, recursive)
    read = files.select("path", decoded(F.col("content"), lossy).alias("text")).unionByName(_empty(spark, files).withColumn("text", F.lit("")))
    return read.select(F.col("path").alias("file_path"), _base_name(F.col("path")).alias("file_name"), "text")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.[tT][xX][tT]", recursive: bool = True) -> DataFrame:
    """file_path, file_name, bytes; contents aren't read."""
    files = _binary(spark, folder, pattern, recursive)
    read = files.select("path", "length").unionByName(_empty(spark, files).withColumn("length", F.lit(0).cast("long")))
    return read.select(F.col("path").alias("file_path"), _base_name(F.col("path")).alias("file_name"), F.col("length").alias("bytes"))


def numbered(paths: DataFrame) -> DataFrame:
    """file_path, patient_id: the 0-based place of each path among all.

    Paths are sorted in ranges and numbered in each; the driver adds up the ranges' sizes. They are persisted, as both
    passes must see the same ranges.
    """
    ranged = paths.select("file_path").repartitionByRange("file_path").sortWithinPartitions("file_path")
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select("file_path", F.spark_partition_id().alias("area"), inner.alias("at")).persist()
    before, rows = 0, []
    for r in sorted(placed.groupBy("area").count().collect()):
        rows.append((r.area, before))
        before += r["count"]
    offsets = paths.sparkSession.createDataFrame(rows, "area int, before long")
    return placed.join(F.broadcast(offsets), "area").select("file_path", (F.col("before") + F.col("at")).alias("patient_id"))


def read_notes(spark: SparkSession, folder: str, without: str | None = None) -> DataFrame:
    """read_files and patient_id, the 0-based place of the path among all; only paths are ordered, contents are joined.

    What lies below the folder without is left out.
    """
    read, listed = read_files(spark, folder), list_files(spark, folder)
    if without:
        inside = F.col("file_path").startswith(qualified(spark, without) + "/")
        read, listed = read.where(~inside), listed.where(~inside)
    return read.join(numbered(listed), "file_path")


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as paths of its files begin: with scheme, without a slash at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def relative_path(path: Column, base: str) -> Column:
    """A path below base, which is qualified; the name of a path that isn't."""
    return F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 20)).otherwise(_base_name(path))


def output_path(relative: Column, folder: str) -> Column:
    """Where the note of an input goes: the same place below the folder, as .txt."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(relative, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))


def discover_notes(spark: SparkSession, root: str, output: str | None = None) -> DataFrame:
    """strategy (first folder, or the root's name), file_name, relative_path, file_path of generated notes, in order.

    What lies below the output folder is left out.
    """
    base = qualified(spark, root)
    files = valid_note_names(list_files(spark, root))
    if output:
        files = files.where(~F.col("file_path").startswith(qualified(spark, output) + "/"))
    rows = files.withColumn("relative_path", relative_path(F.col("file_path"), base))
    parts = F.split("relative_path", "/")
    strategy = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(base.rsplit("/", 1)[-1]))
    found = rows.select(strategy.alias("strategy"), "file_name", "relative_path", "file_path").dropDuplicates(["strategy", "relative_path"])
    return found.orderBy("strategy", "relative_path")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """stem, text, ann: texts and annotations of one stem."""
    side = lambda p, n: read_files(spark, folder, p, recursive=False, lossy=True).select(_stem(F.col("file_name")).alias("stem"), F.col("text").alias(n))
    return side("*.txt", "text").join(side("*.ann", "ann"), "stem")


def ann_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, line of all annotation files."""
    return read_files(spark, folder, "*.ann", recursive=False, lossy=True).select("file_name", F.explode(F.split("text", "\n")).alias("line"))


def read_completed(spark: SparkSession, jsonl: str) -> DataFrame:
    """file_name of judged notes in a JSONL log; blank and bad lines and incomplete scores are passed over."""
    from notegrain.operators.judging import complete, validated

    lines = spark.read.text(jsonl).select(F.try_parse_json("value").alias("v")).where("v is not null")
    name = F.coalesce(F.try_variant_get("v", "$.filename", "string"), F.try_variant_get("v", "$.generated_filename", "string"))
    rows = lines.select(F.lit("").alias("strategy"), name.alias("file_name"), F.lit("").alias("relative_path"), F.to_json(F.try_variant_get("v", "$.result", "variant")).alias("raw_text"))
    return complete(validated(rows.where("file_name is not null"))).select("file_name").distinct()


def read_completed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results file whose nine scores are all valid; filename may be named generated_filename.

    A file that isn't there, or has no such columns, has no rows. The parts of a folder have one header.
    """
    from notegrain.operators.judging import SCORES, csv_score_valid

    none = spark.createDataFrame([], "filename string, strategy string, relative_path string")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return none
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c for c in ("filename", "generated_filename") if c in rows.columns]
    if not names or not {f"{k}_score" for k in SCORES} <= set(rows.columns):
        return none
    for key in SCORES:
        rows = rows.where(csv_score_valid(F.col(f"{key}_score")))
    return rows.withColumn("filename", F.coalesce(*names))


def completed_names(spark: SparkSession, jsonl: str | None = None, csv: str | None = None) -> DataFrame:
    """file_name of notes that a log or a results file has valid scores of."""
    found = spark.createDataFrame([], "file_name string")
    if jsonl:
        there = spark._jvm.org.apache.hadoop.fs.Path(jsonl)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            found = found.unionByName(read_completed(spark, jsonl))
    if csv:
        found = found.unionByName(read_completed_csv(spark, csv).select(F.col("filename").alias("file_name")))
    return found.distinct()


def restored_name(stem: Column) -> Column:
    """Name of an untagged file: .tagged goes, else a last t."""
    return F.when(stem.endswith(".tagged"), F.regexp_replace(stem, r"\.tagged$", "")).when(stem.endswith("t"), F.regexp_replace(stem, "t$", "")).otherwise(stem)


def tagged_name(stem: Column) -> Column:
    return F.concat(stem, F.lit("t.txt"))


def case_text(content: Column) -> Column:
    """A case as it goes into a prompt."""
    return strip(decoded(content, lossy=True))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows appended as one atomic job."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """Records, nulls written as such, appended as one atomic job."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_files(df: DataFrame, folder: str) -> int:
    """file_name, content -> a file for each row below the folder, which executors reach; the number of files.

    A file is written under another name and then moved, so it is there whole or not at all, and a task that is run again
    writes the same. Null content is an empty file. Of rows with one name the last one written stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base.rstrip('/')}/{name}"
                parent, _, last = path.rpartition("/")
                store.create_dir(parent, recursive=True)
                hidden = f"{parent}/.{last}.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as f:
                    f.write((content or "").encode("utf-8", "surrogatepass"))
                store.move(hidden, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    done = df.select(F.col("file_name").cast("string"), F.col("content").cast("string")).mapInArrow(run, "files long").agg(F.sum("files")).first()
    return int(done[0] or 0) if done else 0


def staged(folder: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps rows by writing them below the folder and reading them again.

    What services and models answer costs much and may not come out alike twice: once written it outlives executors, and
    later writes near its inputs don't bring it to be made anew.
    """

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


def drop_staged(spark: SparkSession, folder: str) -> None:
    """What staged(folder) wrote is deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_staging")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_folder(spark: SparkSession, path: str) -> None:
    """A table that is one file becomes a folder of that name with the file as its first part, so that rows can be appended."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    whole = hadoop.Path(path)
    store = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(whole) and store.getFileStatus(whole).isFile():
        aside = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
        store.rename(whole, aside)
        store.mkdirs(whole)
        store.rename(aside, hadoop.Path(f"{path}/part-earlier"))


def clear_files(folder: str, ending: str = ".ann") -> int:
    """Files of an ending right in a folder are deleted; their number. A folder that isn't there has none."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ending)]
    for name in names:
        store.delete_file(name)
    return len(names)


#: How generators of one provider are set.
GENERATOR_OPTIONS = {"num_predict": 3000, "temperature": 0.2, "top_p": 0.9, "top_k": 40, "repeat_penalty": 1.05, "seed": 12345}


@dataclass(frozen=True)
class ServiceConfig:
    """What a run of a model service needs; nothing is read from globals."""

    provider: str
    model: str
    base_url: str = ""
    timeout_s: float = 600.0
    attempts: int = 3
    pause_s: float = 0.2
    most_tokens: int = 6000
    options: dict[str, Any] = field(default_factory=dict)
    think: bool | None = None
    json_format: bool = False
    effort: str = "medium"
    verbosity: str = "low"
    api_key: str = field(default="", repr=False)


#: Variables of the environment that hold a provider's key, model and address.
_VARIABLES = {
    "openai": ("OPENAI_API_KEY", "OPENAI_MODEL", ""),
    "zai": ("NEBIUS_API_KEY", "ZAI_MODEL", "ZAI_BASE_URL"),
    "claude": ("ANTHROPIC_API_KEY", "CLAUDE_MODEL", ""),
    "ollama": ("", "OLLAMA_MODEL", "OLLAMA_BASE_URL"),
}


def service_config(provider: str, environment: Mapping[str, str], judge: bool = False, **given: Any) -> ServiceConfig:
    """A provider's settings: what is given, else what the environment has. Keys and models that are missing are an error."""
    key, model, address = (environment.get(v, "").strip() if v else "" for v in _VARIABLES[provider])
    known: dict[str, Any] = {"provider": provider, "model": model, "base_url": address, "api_key": key, "attempts": 3 if judge else 1}
    if provider == "ollama":
        known["base_url"] = address or "http://127.0.0.1:11434"
        known |= {"json_format": environment.get("OLLAMA_FORMAT_JSON", "1").strip().lower() not in ("0", "false", "no"), "think": tri_state(environment.get("OLLAMA_THINK")), "options": json_options(environment.get("OLLAMA_OPTIONS_JSON"))} if judge else {"think": False, "options": dict(GENERATOR_OPTIONS)}
    config = ServiceConfig(**(known | {k: v for k, v in given.items() if v is not None}))
    if not config.model or (_VARIABLES[provider][0] and not config.api_key) or (provider == "zai" and not config.base_url):
        raise ValueError(f"{provider}: a model, a key or an address is missing")
    return config


def tri_state(text: str | None) -> bool | None:
    """true, false, or not said."""
    word = (text or "").strip().lower()
    return True if word in ("1", "true", "yes", "si", "sí") else False if word in ("0", "false", "no") else None


def json_options(text: str | None) -> dict[str, Any]:
    """A JSON object of options; anything else is an error."""
    found = json.loads(text) if text and text.strip() else {}
    if not isinstance(found, dict):
        raise ValueError("options must be a JSON object")
    return found
