"""Language-model backends for the assistant: two HTTP interfaces, one form of reply, errors with their codes.

A backend is called with messages and tool schemas and returns {content, tool_calls: [{id, name, arguments}]}.
Messages are those of plans.assistant: roles system, user, assistant (with tool_calls) and tool (with id, name).
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from .assistant import BackendError

TIMEOUT_S = 180
Post = Callable[[str, dict, dict], dict]


def post(url: str, body: dict, headers: dict) -> dict:
    """POST as JSON; HTTP errors keep their code, a failed connection counts as 503 and a timeout as 408."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        raise BackendError(e.read().decode("utf-8", "replace")[:500], e.code) from e
    except TimeoutError as e:
        raise BackendError("no answer in time", 408) from e
    except urllib.error.URLError as e:
        raise BackendError(str(e.reason), 503) from e
    except json.JSONDecodeError as e:
        raise BackendError("the answer is no JSON", 502) from e


class ChatCompletions:
    """Services with the common /chat/completions interface."""

    def __init__(self, model: str, key: str, base_url: str, send: Post = post):
        self.name, self.key, self.url, self.send = model, key, base_url.rstrip("/") + "/chat/completions", send

    def said(self, m: dict) -> dict:
        if m["role"] == "tool":
            return {"role": "tool", "tool_call_id": m["id"], "content": m["content"]}
        out = {"role": m["role"], "content": m.get("content") or ""}
        if m.get("tool_calls"):
            out["tool_calls"] = [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": json.dumps(c["arguments"])}} for c in m["tool_calls"]]
        return out

    def __call__(self, messages: list[dict], schemas: list[dict]) -> dict:
        body: dict = {"model": self.name, "messages": [self.said(m) for m in messages]}
        if schemas:
            body["tools"] = [{"type": "function", "function": s} for s in schemas]
        reply = self.send(self.url, body, {"Authorization": f"Bearer {self.key}"})
        if "error" in reply:  # some services answer 200 with an error inside
            raise BackendError(str(reply["error"].get("message", reply["error"])), reply["error"].get("code"))
        try:
            message = reply["choices"][0]["message"]
        except (KeyError, IndexError) as e:
            raise BackendError("the answer has no choice", 502) from e
        calls = []
        for k, c in enumerate(message.get("tool_calls") or []):
            try:
                arguments = json.loads(c["function"].get("arguments") or "{}")
            except json.JSONDecodeError:
                arguments = {}
            calls.append({"id": c.get("id") or f"call-{k}", "name": c["function"]["name"], "arguments": arguments})
        return {"content": message.get("content") or "", "tool_calls": calls}


class GenerateContent:
    """Services with the :generateContent interface: parts instead of messages, calls without ids."""

    def __init__(self, model: str, key: str, base_url: str, send: Post = post):
        self.name, self.key, self.url, self.send = model, key, f"{base_url.rstrip('/')}/models/{model}:generateContent", send

    @staticmethod
    def part(m: dict) -> dict:
        if m["role"] == "tool":
            return {"role": "user", "parts": [{"functionResponse": {"name": m["name"], "response": {"result": m["content"]}}}]}
        parts = [{"text": m["content"]}] if m.get("content") else []
        parts += [{"functionCall": {"name": c["name"], "args": c["arguments"]}} for c in m.get("tool_calls") or []]
        return {"role": "model" if m["role"] == "assistant" else "user", "parts": parts or [{"text": ""}]}

    def __call__(self, messages: list[dict], schemas: list[dict]) -> dict:
        body: dict = {"contents": [self.part(m) for m in messages if m["role"] != "system"]}
        if system := "\n".join(m["content"] for m in messages if m["role"] == "system"):
            body["systemInstruction"] = {"parts": [{"text": system}]}
        if schemas:
            body["tools"] = [{"functionDeclarations": schemas}]
        reply = self.send(self.url, body, {"x-goog-api-key": self.key})
        try:
            parts = reply["candidates"][0]["content"].get("parts", [])
        except (KeyError, IndexError) as e:
            raise BackendError("the answer has no candidate", 502) from e
        calls = [{"id": f"call-{k}", "name": p["functionCall"]["name"], "arguments": dict(p["functionCall"].get("args") or {})} for k, p in enumerate(parts) if "functionCall" in p]
        return {"content": "".join(p.get("text", "") for p in parts), "tool_calls": calls}


KINDS = {"chat": ChatCompletions, "generate": GenerateContent}


def make(kind: str, model: str, key: str | None, base_url: str, send: Post = post):
    if kind not in KINDS:
        raise ValueError(f"no backend {kind!r}; there are {', '.join(sorted(KINDS))}")
    if not key:
        raise ValueError(f"the {kind} backend needs a key")
    return KINDS[kind](model, key, base_url, send)
