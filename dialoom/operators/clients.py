"""Language-model clients over HTTP, their factory, and the calls that a task makes through them.

A client is picklable: it holds addresses and names, and looks its key up where
it runs, so that no key is written into a plan. The transport is a function and
can be replaced, as the tests do.
"""

from __future__ import annotations

import itertools
import json
import logging
import os
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from dialoom.operators.dialogue import MockClient
from dialoom.sources import config as settings

log = logging.getLogger(__name__)

#: (address, headers, body, seconds) -> the answer's JSON; raises for any failure.
Transport = Callable[[str, dict, dict, float], dict]

# The public interfaces of the providers, and the models taken where none is named.
BASES = {"openai": "https://api.openai.com/v1", "openrouter": "https://openrouter.ai/api/v1", "anthropic": "https://api.anthropic.com/v1"}
MODELS = {"openai": "gpt-4o-mini", "openrouter": "openai/gpt-4o-mini", "anthropic": "claude-3-opus-20240229"}
COMPLETIONS, MESSAGES = "/chat/completions", "/messages"
MESSAGES_VERSION = "2023-06-01"
MAX_TOKENS, TEMPERATURE = 2048, 0.7
UNSET_KEY = "YOUR_API_KEY_HERE"


def post(url: str, headers: dict, body: dict, seconds: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return json.load(answer)


def key_variable(provider: str) -> str:
    return f"{provider.upper()}_API_KEY"


@dataclass(frozen=True)
class HttpClient:
    """One of the two public request shapes: chat completions, or messages."""

    provider: str
    model: str
    base: str
    params: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    key: str | None = None
    transport: Transport = post
    seconds: float = 120.0

    def _key(self) -> str:
        key = self.key or os.environ.get(key_variable(self.provider), "")
        if not key:
            raise RuntimeError(f"{key_variable(self.provider)} is not set where the call is made")
        return key

    def request(self, prompt: str) -> tuple[str, dict, dict]:
        """(address, headers, body) of a call."""
        p = dict(self.params)
        most = p.pop("max_completion_tokens", None) or p.pop("max_tokens", None) or MAX_TOKENS
        p.pop("max_tokens", None)
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": p.pop("temperature", TEMPERATURE)}
        if self.provider == "anthropic":
            return self.base + MESSAGES, {"x-api-key": self._key(), "anthropic-version": MESSAGES_VERSION} | self.headers, body | {"max_tokens": most}
        return self.base + COMPLETIONS, {"Authorization": f"Bearer {self._key()}"} | self.headers, body | {"max_completion_tokens": most} | p

    def generate_with_tokens(self, prompt: str) -> tuple[str, int, int]:
        """(text, input tokens, output tokens); a missing usage counts 0."""
        got = self.transport(*self.request(prompt), self.seconds)
        said = got.get("usage") or {}
        try:
            if self.provider == "anthropic":
                return got["content"][0]["text"].strip(), said.get("input_tokens", 0), said.get("output_tokens", 0)
            return (got["choices"][0]["message"]["content"] or "").strip(), said.get("prompt_tokens", 0), said.get("completion_tokens", 0)
        except (KeyError, IndexError, TypeError) as e:
            raise RuntimeError(f"{self.provider}: an answer of another shape") from e

    def generate(self, prompt: str) -> str:
        return self.generate_with_tokens(prompt)[0]


def create_client(api: dict, transport: Transport = post) -> HttpClient | MockClient:
    """The client of a configuration.

    Without a key, in the configuration or the environment, it is the mock one,
    with a warning. An endpoint may be the full address of a call. An unknown
    provider is an error.
    """
    provider = str(api.get("provider") or "openai").lower()
    given = api.get("api_key") or ""
    if given == UNSET_KEY:
        given = ""
    given, where = settings.resolve_key(given, (key_variable(provider),))
    if not given:
        log.warning("no API key for %s: the mock client answers", provider)
        return MockClient()
    if provider not in BASES:
        raise ValueError(f"unknown provider {provider!r}")
    base = api.get("base_url") or (api.get("endpoint") or "").removesuffix(COMPLETIONS) or BASES[provider]
    return HttpClient(
        provider,
        api.get("model") or MODELS[provider],
        (BASES[provider] if provider == "anthropic" else base).rstrip("/"),
        dict(api.get("inference") or {}),
        dict(api.get("default_headers") or api.get("headers") or {}),
        given if where == "config" else None,
        transport,
    )


class Metered:
    """A client whose calls are noted: (operation, input tokens, output tokens), also of answers that are thrown away."""

    def __init__(self, client, operation: str = "generate"):
        self.client, self.operation = client, operation
        self.calls: list[tuple[str, int, int]] = []

    def generate(self, prompt: str) -> str:
        if hasattr(self.client, "generate_with_tokens"):
            out, asked, said = self.client.generate_with_tokens(prompt)
        else:
            out, asked, said = self.client.generate(prompt), 0, 0
        self.calls.append((self.operation, asked, said))
        return out


def name_of(client) -> tuple[str, str]:
    """(provider, model) for usage records."""
    return getattr(client, "provider", "mock"), getattr(client, "model", "mock")


def pooled(f: Callable, items: Iterable, workers: int) -> Iterator:
    """f of each item in order, with so many calls under way at once and no more than twice as many waiting.

    An error of f is raised at its item's turn.
    """
    if workers <= 1:
        yield from map(f, items)
        return
    rest = iter(items)
    with ThreadPoolExecutor(workers) as pool:
        waiting = [pool.submit(f, x) for x in itertools.islice(rest, 2 * workers)]
        try:
            while waiting:
                yield waiting.pop(0).result()
                waiting += [pool.submit(f, x) for x in itertools.islice(rest, 1)]
        finally:
            for w in waiting:
                w.cancel()
