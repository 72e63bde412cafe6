"""Clients of chat and embedding endpoints that speak the common completions protocol, for ``calls`` and
``embedding``. They run on the executors; no client library is needed."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.error import HTTPError
from urllib.request import Request as Http
from urllib.request import urlopen

from .. import fixed
from .calls import Reply, Request

TIMEOUT = 120.0


def _post(url: str, key: str | None, body: dict, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urlopen(Http(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
            return json.load(r)
    except HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read(500).decode('utf-8', 'replace')}") from e


def chat(model: str, base_url: str, key: str | None = None, timeout: float = TIMEOUT) -> Callable[[Request], Reply]:
    """A chat model; ``model`` without its provider's name before the slash."""

    def client(r: Request) -> Reply:
        body = {"model": model, "messages": [*([{"role": "system", "content": r.system}] if r.system else []), {"role": "user", "content": r.prompt}], "temperature": fixed.MODEL_TEMPERATURE, "seed": fixed.MODEL_SEED}
        if r.max_tokens:
            body["max_tokens"] = r.max_tokens
        if r.as_json:
            body["response_format"] = {"type": "json_object"}
        got = _post(f"{base_url.rstrip('/')}/chat/completions", key, body, timeout)
        said, used = got["choices"][0], got.get("usage") or {}
        message = said.get("message") or {}
        text = message.get("content")
        text = message.get("reasoning_content") if text is None else text  # some hosts put all of it there
        return Reply((text or "").strip(), said.get("finish_reason") == "length", int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0))

    return client


def embed(model: str, base_url: str, key: str | None = None, timeout: float = TIMEOUT) -> Callable[[list[str]], list[list[float]]]:
    def client(texts: list[str]) -> list[list[float]]:
        got = _post(f"{base_url.rstrip('/')}/embeddings", key, {"model": model, "input": texts}, timeout)
        return [x["embedding"] for x in sorted(got["data"], key=lambda x: x.get("index", 0))]

    return client
