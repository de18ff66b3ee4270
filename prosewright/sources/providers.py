"""Rewriting providers: a protocol, a stub, two HTTP kinds, retries and a factory."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field


class ProviderError(Exception):
    """A call failed in a way that may pass."""


class ProviderTimeout(ProviderError):
    pass


@dataclass
class Completion:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


def backoff(attempt: int, first: float = 0.5, most: float = 8.0) -> float:
    """Seconds before the attempt after number ``attempt``: doubled each time, up to ``most``."""
    return min(most, first * 2 ** (attempt - 1))


def with_retry(call: Callable[[], Completion], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Completion:
    """Repeats a call that raises ProviderError; other errors pass through."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except ProviderError:
            if n == attempts:
                raise
            sleep(backoff(n))
    raise ProviderError("no attempt was made")


@dataclass
class Stub:
    """Answers by a rule: a function of the prompt, a dict, a list taken in turn, or the prompt itself."""

    rule: Callable[[str], str] | dict | list | str | None = None
    fail_first: int = 0
    calls: int = field(default=0, init=False)

    def complete(self, prompt: str, system: str | None = None) -> Completion:
        self.calls += 1
        if self.calls <= self.fail_first:
            raise ProviderError("scripted failure")
        if callable(self.rule):
            text = self.rule(prompt)
        elif isinstance(self.rule, dict):
            text = self.rule.get(prompt, prompt)
        elif isinstance(self.rule, list):
            text = self.rule[min(self.calls - self.fail_first, len(self.rule)) - 1]
        else:
            text = prompt if self.rule is None else self.rule
        return Completion(text, len(prompt.split()) + len((system or "").split()), len(text.split()))


Transport = Callable[[str, dict, dict, float], dict]


def post_json(url: str, payload: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", "User-Agent": "prosewright", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except TimeoutError as e:
        raise ProviderTimeout(str(e)) from e
    except urllib.error.HTTPError as e:
        if e.code < 500 and e.code != 429:
            raise ValueError(f"rejected: {e}") from e  # trying again won't help
        raise ProviderError(str(e)) from e
    except (OSError, ValueError) as e:
        raise ProviderError(str(e)) from e


@dataclass
class ChatHttp:
    """Chat-completions over HTTP."""

    model: str
    base_url: str
    key: str = ""
    timeout: float = 30.0
    transport: Transport = post_json

    def complete(self, prompt: str, system: str | None = None) -> Completion:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        got = self.transport(f"{self.base_url.rstrip('/')}/chat/completions", {"model": self.model, "messages": messages}, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        try:
            used = got.get("usage") or {}
            return Completion(got["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0))
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("malformed reply") from e


@dataclass
class GenerateHttp:
    """One-prompt generation over HTTP; reasoning between think tags is cut."""

    model: str
    base_url: str = "http://localhost:11434"
    timeout: float = 30.0
    transport: Transport = post_json

    def complete(self, prompt: str, system: str | None = None) -> Completion:
        import re

        got = self.transport(f"{self.base_url.rstrip('/')}/api/generate", {"model": self.model, "prompt": prompt, "system": system or "", "stream": False}, {}, self.timeout)
        if not isinstance(got.get("response"), str):
            raise ProviderError("malformed reply")
        return Completion(re.sub(r"(?is)<think>.*?</think>\s*", "", got["response"]), got.get("prompt_eval_count", 0), got.get("eval_count", 0))


def provider(kind: str, model: str = "", base_url: str = "", key: str = "", **more):
    """A provider by kind: stub, openai_compat or ollama."""
    if kind == "stub":
        return Stub(**more)
    if kind == "ollama":
        return GenerateHttp(model, base_url or "http://localhost:11434", **more)
    if kind == "openai_compat":
        if not base_url:
            raise ValueError("base_url is needed")
        return ChatHttp(model, base_url, key, **more)
    raise ValueError(f"unknown provider: {kind}")
