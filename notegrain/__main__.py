"""python -m notegrain generate | judge | tag | untag | extract | evaluate, each with --help."""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession

from notegrain.operators import extraction, services
from notegrain.operators.clients import HttpClient
from notegrain.plans import runs
from notegrain.sources import files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="notegrain")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *folders: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for folder in folders:
            p.add_argument(f"--{folder}", required=True)
        return p

    def prompts(p: argparse.ArgumentParser) -> None:
        p.add_argument("--system-file", type=Path, required=True, help="the system prompt")
        p.add_argument("--template-file", type=Path, required=True, help="the prompt, with a mark where the text goes")
        p.add_argument("--model")
        p.add_argument("--base-url")

    p = command("generate", "a note for each case", "input-dir", "output-dir")
    prompts(p)
    p.add_argument("--provider", choices=["openai", "zai", "claude", "ollama"], default=os.environ.get("MODEL_PROVIDER", "openai").strip().lower())
    p.add_argument("--log-csv")
    p.add_argument("--overwrite", action="store_true")
    p = command("judge", "scores of generated notes", "generated-notes-dir", "output-dir")
    prompts(p)
    p.add_argument("--request-sleep", type=float, default=0.2)
    p.add_argument("--debug-jsonl", action="store_true")
    command("tag", "annotations into texts", "input-dir", "output-dir")
    command("untag", "tags out of texts", "input-dir", "output-dir")
    p = command("extract", "mentions in notes", "untagged-dir")
    p.add_argument("--output-dir")
    p.add_argument("--min-score", type=float, default=0.85)
    p.add_argument("--average-model", action="append", default=[], help="a token classifier whose span scores are means")
    p.add_argument("--least-model", action="append", default=[], help="one whose span scores are the least of their tokens'")
    p = command("evaluate", "predicted annotations against silver ones", "silver-ann-dir", "pred-ann-dir", "output-dir")
    p.add_argument("--no-normalize-text", action="store_true")
    p.add_argument("--case-sensitive-text", action="store_true")
    return top


def _pretrained(name: str, cap: int):  # noqa: ANN202  the class needs libraries that only workers may have
    return lambda: services.PretrainedClassifier(name, cap)


def run(arguments: list[str] | None, spark: SparkSession) -> dict:
    """What a command gives back: counts, or the global metrics."""
    a = _parser().parse_args(arguments)
    if a.command == "tag" or a.command == "untag":
        return getattr(runs, a.command)(spark, a.input_dir, a.output_dir)
    if a.command == "evaluate":
        return runs.evaluate(spark, a.silver_ann_dir, a.pred_ann_dir, a.output_dir, not a.no_normalize_text, a.case_sensitive_text)
    if a.command == "extract":
        flow = lambda names, cap, **more: extraction.Workflow({n: _pretrained(n, cap) for n in names}, low=a.min_score, **more)
        flows = {"average": flow(a.average_model, 0, average=True, batch=16), "least": flow(a.least_model, 512, average=False, batch=8)}
        return runs.extract(spark, a.untagged_dir, a.output_dir or f"{a.untagged_dir.rstrip('/')}/SilverMentions", {n: f for n, f in flows.items() if f.models})
    system, template = a.system_file.read_text(encoding="utf-8"), a.template_file.read_text(encoding="utf-8")
    if a.command == "judge":
        config = files.service_config("ollama", os.environ, judge=True, model=a.model, base_url=a.base_url, pause_s=a.request_sleep)
        return runs.judge(spark, a.generated_notes_dir, a.output_dir, config, HttpClient, system, template, a.debug_jsonl)
    config = files.service_config(a.provider, os.environ, model=a.model, base_url=a.base_url)
    return runs.generate(spark, a.input_dir, a.output_dir, config, HttpClient, system, template, a.overwrite, a.log_csv)


def main() -> None:
    spark = SparkSession.builder.appName("notegrain").getOrCreate()
    print(json.dumps(run(None, spark), ensure_ascii=False))
    spark.stop()


if __name__ == "__main__":
    main()
