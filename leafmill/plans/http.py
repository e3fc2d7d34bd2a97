"""A chat model behind an HTTP service that speaks chat completions."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from .rounds import ANSWER_TOKENS, Chat, ServiceError

#: Seconds that a request may take.
TIMEOUT = 180


def request_body(prompt: str, model: str, fields: dict, temperature: float = 0.3) -> dict:
    """What is posted. Thinking is told only where it is switched on or off, JSON only where it is asked for."""
    body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}
    if fields.get("json"):
        body["response_format"] = {"type": "json_object"}
    if fields.get("thinking") in ("enabled", "disabled"):
        body["thinking"] = {"type": fields["thinking"]}
    if fields.get("max_tokens"):
        body["max_tokens"] = int(fields["max_tokens"])
    return body


def said(raw: bytes) -> tuple[str, int, str]:
    """F39 for one reply: content, output tokens, finish reason."""
    try:
        got = json.loads(raw.decode("utf-8"))
        first = got["choices"][0]
        tokens = (got.get("usage") or {}).get("completion_tokens") or 0
        return (first.get("message") or {}).get("content") or "", int(tokens), first.get("finish_reason") or ""
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
        raise ServiceError(0, f"an unexpected reply: {raw[:400]!r}") from e


def http_chat(base_url: str, key: str, model: str, timeout: float = TIMEOUT, thinking: str = "disabled", max_tokens: int = ANSWER_TOKENS) -> Chat:
    """The backend. rounds.Limits say how often a request is tried; a time-out is told as TimeoutError whether it comes before or after the
    connection stands. The key travels with the task to the executors and is never logged."""
    if not key:
        raise ValueError("a key for the service is needed")
    url = base_url.rstrip("/") + ("" if base_url.rstrip("/").endswith("/chat/completions") else "/chat/completions")

    def call(prompt: str, fields: dict) -> tuple[str, int, str]:
        body = json.dumps(request_body(prompt, model, fields), ensure_ascii=False).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}", "Accept": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return said(reply.read())
        except urllib.error.HTTPError as e:
            raise ServiceError(e.code, e.read().decode("utf-8", "replace")[:400]) from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError(str(e.reason)) from e
            raise ConnectionError(str(e.reason)) from e

    return Chat(call, thinking, max_tokens)
