"""Clients that speak HTTP, with the standard library only."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any

from notegrain.sources.files import ServiceConfig

#: Where a provider listens if the configuration doesn't say, and the path of a request.
_ADDRESSES = {"openai": ("https://api.openai.com/v1", "/responses"), "zai": ("", "/chat/completions"), "claude": ("https://api.anthropic.com/v1", "/messages"), "ollama": ("http://127.0.0.1:11434", "/api/chat")}


class ServiceError(Exception):
    """An answer with a status that says no."""

    def __init__(self, code: int, words: str):
        super().__init__(f"{code}: {words}")
        self.status_code = code


class HttpClient:
    """Posts request bodies as JSON and reads answers as JSON objects."""

    def __init__(self, config: ServiceConfig):
        base, path = _ADDRESSES[config.provider]
        self.url, self.timeout = (config.base_url or base).rstrip("/") + path, config.timeout_s
        self.headers = {"Content-Type": "application/json"}
        if config.provider == "claude":
            self.headers |= {"x-api-key": config.api_key, "anthropic-version": "2023-06-01"}
        elif config.api_key:
            self.headers["Authorization"] = f"Bearer {config.api_key}"

    def send(self, body: dict[str, Any]) -> dict[str, Any]:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), self.headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            raise ServiceError(e.code, e.read().decode("utf-8", "replace")[:2000]) from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError(str(e.reason)) from e
            raise
        if not isinstance(found, dict):
            raise ValueError("the answer is not a JSON object")
        return found
