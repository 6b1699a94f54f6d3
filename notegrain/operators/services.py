"""Models and services behind small protocols: token classifiers, note generators and judges.

A client or classifier is made once for each task by a factory that travels with it; rows stream through in Arrow batches.
Failures become columns of the row, not failures of the job. Real services aren't reachable in tests; fakes stand in.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrain.sources.files import ServiceConfig


#: Tokens that a task gathers before it hands them on.
_TOKENS_AT_ONCE = 20_000


class Client(Protocol):
    """Sends a request body, gives back the service's answer as a dict."""

    def send(self, body: dict[str, Any]) -> dict[str, Any]: ...


class TokenClassifier(Protocol):
    """Cuts a text into windows of tokens and scores labels; windows of (start, end, label, score)."""

    def windows(self, text: str) -> Sequence[Any]: ...

    def classify(self, windows: Sequence[Any]) -> list[list[tuple[int, int, str, float]]]: ...


def longest_window(model_most: int | None, tokenizer_most: int | None, cap: int = 0) -> int:
    """Tokens of a window: the least of what model, tokenizer (unless it says a million or more) and cap allow; 512 if unknown."""
    known = [n for n in (model_most, tokenizer_most if (tokenizer_most or 0) < 1_000_000 else 0) if n and n > 0]
    most = min(known, default=512)
    return min(most, cap) if cap > 0 else most


class PretrainedClassifier:
    """A TokenClassifier of the transformers library, which is imported when the first task needs it.

    On a GPU numbers are halved. Not run here: neither the library nor models are at hand.
    """

    def __init__(self, name: str, cap: int = 0, stride: int = 192):
        import torch
        from transformers import AutoModelForTokenClassification, AutoTokenizer

        self.torch, self.stride = torch, stride
        self.device = torch.device("cuda" if torch.cuda.is_available() else "cpu")
        self.tokenizer = AutoTokenizer.from_pretrained(name, use_fast=True)
        model = AutoModelForTokenClassification.from_pretrained(name).eval().to(self.device)
        self.model = model.half() if self.device.type == "cuda" else model
        self.most = longest_window(getattr(model.config, "max_position_embeddings", None), getattr(self.tokenizer, "model_max_length", None), cap)

    def windows(self, text: str) -> list[dict[str, list]]:
        cut = self.tokenizer(text, truncation=True, max_length=self.most, stride=self.stride, return_overflowing_tokens=True, return_offsets_mapping=True)
        return [{k: cut[k][i] for k in ("input_ids", "attention_mask", "offset_mapping")} for i in range(len(cut["input_ids"]))]

    def classify(self, windows: Sequence[dict[str, list]]) -> list[list[tuple[int, int, str, float]]]:
        padded = self.tokenizer.pad([{k: w[k] for k in ("input_ids", "attention_mask")} for w in windows], return_tensors="pt")
        try:
            with self.torch.inference_mode():
                logits = self.model(**{k: v.to(self.device) for k, v in padded.items()}).logits
        except RuntimeError:
            if self.device.type == "cuda":
                self.torch.cuda.empty_cache()
            raise
        best = logits.float().softmax(-1).max(-1)
        names = self.model.config.id2label
        return [[(a, b, names[k], p) for (a, b), k, p in zip(w["offset_mapping"], row_k, row_p, strict=False)] for w, row_k, row_p in zip(windows, best.indices.tolist(), best.values.tolist(), strict=True)]


class DictionaryClassifier:
    """A TokenClassifier without a model: words of letters get the label that a dictionary has for them, with score 1."""

    def __init__(self, labels: Mapping[str, str], window: int = 256, stride: int = 64):
        self.labels, self.window, self.step = dict(labels), window, max(1, window - stride)

    def windows(self, text: str) -> list[list[tuple[int, int, str]]]:
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", text)]
        return [words[k : k + self.window] for k in range(0, max(1, len(words)), self.step) if k == 0 or k + self.window - self.step < len(words)]

    def classify(self, windows: Sequence[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str, float]]]:
        return [[(0, 0, "O", 1.0), *((a, b, self.labels.get(w, "O"), 1.0) for a, b, w in words)] for words in windows]


def request_body(config: ServiceConfig, system: str, prompt: str) -> dict[str, Any]:
    """A provider's request."""
    messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
    if config.provider == "claude":
        return {"model": config.model, "system": system, "max_tokens": config.most_tokens, "messages": messages[1:]}
    if config.provider == "ollama":
        body: dict[str, Any] = {"model": config.model, "stream": False, "messages": messages}
        body |= {"format": "json"} if config.json_format else {}
        body |= {"think": config.think} if config.think is not None else {}
        return body | ({"options": dict(config.options)} if config.options else {})
    if config.provider == "openai":
        said = [{"role": m["role"], "content": [{"type": "input_text", "text": m["content"]}]} for m in messages]
        return {"model": config.model, "reasoning": {"effort": config.effort}, "text": {"verbosity": config.verbosity}, "max_output_tokens": config.most_tokens, "input": said}
    return {"model": config.model, "messages": messages, "max_tokens": config.most_tokens}


def _texts(parts: Any, kind: str | None) -> list[str]:
    """Texts, stripped, of the parts of a kind; empty ones go."""
    found = [p.get("text") for p in parts or [] if isinstance(p, dict) and kind in (None, p.get("type"))]
    return [t.strip() for t in found if isinstance(t, str) and t.strip()]


def _words(value: Any) -> str:
    return value.strip() if isinstance(value, str) else ""


def answer_text(provider: str, answer: dict[str, Any]) -> tuple[str, str]:
    """Content and thinking of a provider's answer."""
    if provider == "claude":
        return "\n".join(_texts(answer.get("content"), "text")), ""
    if provider == "ollama":
        message = answer.get("message")
        if isinstance(message, dict) and isinstance(message.get("content", ""), str):
            return _words(message.get("content")), _words(message.get("thinking"))
        return _words(answer.get("response")), ""
    whole = _words(answer.get("output_text"))
    if not whole and isinstance(answer.get("choices"), list) and answer["choices"]:
        whole = _words((answer["choices"][0].get("message") or {}).get("content"))
    items = [i for i in answer.get("output") or [] if isinstance(i, dict) and i.get("type") == "message"]
    return whole or "\n".join(t for i in items for t in _texts(i.get("content"), None)), ""


#: Diagnostics by provider: name, path in the answer, what stands for nothing (null: the name is left out).
_DIAGNOSTICS = {
    "openai": (("status", "status", "unknown"), ("incomplete_reason", "incomplete_details.reason", "none"), ("output_tokens", "usage.output_tokens", "unknown"), ("reasoning_tokens", "usage.output_tokens_details.reasoning_tokens", "unknown")),
    "claude": (("stop_reason", "stop_reason", "unknown"), ("input_tokens", "usage.input_tokens", "unknown"), ("output_tokens", "usage.output_tokens", "unknown"), ("cache_read", "usage.cache_read_input_tokens", None), ("cache_creation", "usage.cache_creation_input_tokens", None)),
}


def diagnostics(provider: str, answer: dict[str, Any]) -> str:
    """How an answer ended and what it took, as name=value; empty for providers that tell nothing."""
    out = []
    for name, path, missing in _DIAGNOSTICS.get(provider, _DIAGNOSTICS["openai"] if provider == "zai" else ()):
        value: Any = answer
        for step in path.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        if value not in (None, "") or missing is not None:
            out.append(f"{name}={missing if value in (None, '') else value}")
    return " ".join(out)


def failure_status(provider: str, failure: Exception) -> str:
    """error; of one provider also rate_limit_error, timeout_error, api_error_<code>, by the failure's name and status_code."""
    name, code = type(failure).__name__.lower(), getattr(failure, "status_code", None)
    if provider != "claude":
        return "error"
    if "ratelimit" in name or code == 429:
        return "rate_limit_error"
    return "timeout_error" if "timeout" in name else f"api_error_{code}" if code else "error"


_ANSWER = "content string, thinking string, raw string, status string, error string, attempts int, latency_s double"


def call(rows: DataFrame, config: ServiceConfig, factory: Callable[[ServiceConfig], Client], system: str, template: str, mark: str = "{CASE_TEXT}", accept: Callable[[str], bool] | None = None) -> DataFrame:
    """file_name, case -> also content, thinking, raw, status, error, attempts, latency_s.

    With accept an answer is asked for again, a few times, until one is accepted (status ok) or the last is not (rejected).
    Without, the first answer stands; only failures are asked again. Services aren't deterministic: persist or write the
    result before it is used twice.
    """

    def ask(client: Client, case: str) -> tuple:
        content, thinking, raw, status, error, k = "", "", None, "error", None, 0
        began = time.monotonic()
        for k in range(1, config.attempts + 1):
            try:
                answer = client.send(request_body(config, system, template.replace(mark, case)))
                raw = json.dumps(answer, ensure_ascii=False)
                content, thinking = answer_text(config.provider, answer)
                if accept is None or accept(content):
                    status, error = "ok", None
                    break
                status, error = "rejected", "Empty model response." if not content else "The answer is not accepted."
            except Exception as e:  # noqa: BLE001  whatever a client raises becomes the row's error
                status, error = failure_status(config.provider, e), f"{type(e).__name__}: {e}"
            time.sleep(config.pause_s * k if k < config.attempts else 0)
        return content, thinking, raw, status, error, k, time.monotonic() - began

    names = ["file_name", "case", *(c.split(" ")[0] for c in _ANSWER.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory(config)
        for batch in batches:
            for name, case in zip(batch["file_name"], batch["case"], strict=True):
                yield pd.DataFrame([(name, case, *ask(client, case or ""))], columns=names)

    return rows.select("file_name", F.col("case")).mapInPandas(run, f"file_name string, case string, {_ANSWER}")


def classify_chunks(chunks: DataFrame, models: Mapping[str, Callable[[], TokenClassifier]], batch: int = 16, most_windows: int = 2000) -> DataFrame:
    """doc_id, chunk, start, text (of the chunk) -> tokens doc_id, model, window_id, idx, st, en, label, score, error, of each model.

    A batch that fails is halved until single windows fail; that chunk then has one row with the error.
    """

    def scored(classifier: TokenClassifier, windows: Sequence[Any]) -> list:
        out: list = []
        while len(out) < len(windows):
            size = min(batch, len(windows) - len(out))
            while True:
                try:
                    out += classifier.classify(windows[len(out) : len(out) + size])
                    break
                except RuntimeError:
                    if size == 1:
                        raise
                    size //= 2
        return out

    def tokens(doc_id: int, chunk: int, start: int, text: str, model: str, classifier: TokenClassifier) -> list[tuple]:
        first = int(chunk) * most_windows
        try:
            windows = classifier.windows(text)
            if len(windows) > most_windows:
                raise ValueError(f"{len(windows)} windows in a chunk")
            return [(doc_id, model, first + w, i, a + start if b else 0, b + start if b else 0, label, s, None) for w, found in enumerate(scored(classifier, windows)) for i, (a, b, label, s) in enumerate(found)]
        except Exception as e:  # noqa: BLE001  whatever a model raises becomes a row
            return [(doc_id, model, first, -1, 0, 0, "O", 0.0, f"{model}: {type(e).__name__}: {e}")]

    names = ["doc_id", "model", "window_id", "idx", "st", "en", "label", "score", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifiers = {name: factory() for name, factory in models.items()}
        out: list[tuple] = []
        for rows in batches:
            for row in zip(rows["doc_id"], rows["chunk"], rows["start"], rows["text"], strict=True):
                for name, classifier in classifiers.items():
                    out += tokens(*row, name, classifier)
                if len(out) > _TOKENS_AT_ONCE:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    return chunks.select("doc_id", "chunk", "start", "text").mapInPandas(run, "doc_id long, model string, window_id int, idx int, st int, en int, label string, score double, error string")
