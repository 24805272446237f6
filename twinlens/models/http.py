"""A chat-completions backend over HTTP with the standard library alone."""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

import numpy as np

from ..errors import ClassificationModeError
from .base import ModelBackend
from .lexical import TiktokenTokenizer

log = logging.getLogger("twinlens")
MAX_CLASSES = 20


def error_code(body: str) -> str | None:
    """The service's error code in a response body."""
    try:
        return (json.loads(body).get("error") or {}).get("code")
    except (ValueError, AttributeError):
        return None


class ChatModel(ModelBackend):
    """Texts and class scores of a chat-completions service. ``send(url, payload, timeout)`` can be replaced in tests.

    429, 5xx, connection errors and timeouts are tried again, after 1 s, doubled up to ``backoff_cap``; other errors of
    the 4xx kind are raised at once. The service's fingerprint is asked for once, without sampling parameters; if there is none, the
    backend's identity is unique, so that its cache entries are not shared.
    """

    def __init__(self, model: str, base_url: str = "https://api.openai.com/v1", api_key_env: str = "OPENAI_API_KEY", temperature: float = 0.0, top_p: float = 1.0, max_tokens: int = 512, timeout: float = 60.0, max_retries: int = 10, backoff_cap: float = 60.0, class_prefix: str = " ", send: Callable | None = None, tokenizer=None):
        self.model, self.base_url, self.api_key_env = model, base_url.rstrip("/"), api_key_env
        self.temperature, self.top_p, self.max_tokens, self.timeout = temperature, top_p, max_tokens, timeout
        self.max_retries, self.backoff_cap, self.class_prefix = max_retries, backoff_cap, class_prefix
        self.send, self._tokenizer, self.closed = send or self._post, tokenizer, False
        self.fingerprint = self._warm_up()
        self._seen: set[str] = set()

    @property
    def tokenizer(self):
        self._tokenizer = self._tokenizer or TiktokenTokenizer(self.model)
        return self._tokenizer

    @property
    def cache_id(self) -> str:
        return f"chat:{self.base_url}:{self.model}:{self.fingerprint}:t={self.temperature}:p={self.top_p}:n={self.max_tokens}:x={self.class_prefix!r}"

    def _post(self, url: str, payload: dict, timeout: float) -> dict:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.api_key_env, '')}"}
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), headers), timeout=timeout) as r:
            return json.load(r)

    def _warm_up(self) -> str:
        try:
            mark = self.send(f"{self.base_url}/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": "ping"}]}, self.timeout).get("system_fingerprint")
        except Exception as e:
            log.warning("no fingerprint of the service: %s", type(e).__name__)
            mark = None
        return mark or f"unknown-{uuid.uuid4()}"

    def request(self, payload: dict) -> dict:
        if self.closed:
            raise RuntimeError("the model is closed")
        delay = 1.0
        for attempt in range(self.max_retries + 1):
            try:
                out = self.send(f"{self.base_url}/chat/completions", {"model": self.model, **payload}, self.timeout)
                self._watch(out.get("system_fingerprint"))
                return out
            except urllib.error.HTTPError as e:
                body = e.read().decode("utf-8", "replace") if e.fp else ""
                log.warning("service answered %s (%s): %s", e.code, error_code(body), body[:200])
                if e.code != 429 and e.code < 500 or attempt == self.max_retries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.max_retries:
                    raise
            time.sleep(delay)
            delay = min(2 * delay, self.backoff_cap)
        raise AssertionError

    def _watch(self, mark: str | None) -> None:
        if mark and mark != self.fingerprint and mark not in self._seen:
            self._seen.add(mark)
            log.warning("the service's fingerprint changed from %s to %s", self.fingerprint, mark)

    def validate_classes(self, classes: list[str]) -> None:
        if len(classes) > MAX_CLASSES:
            raise ClassificationModeError(f"the service returns {MAX_CLASSES} candidates; {len(classes)} classes are too many")
        many = [c for c in classes if len(self.tokenizer.encode(self.class_prefix + c)) != 1]
        if many:
            raise ClassificationModeError(f"classes must be one token each behind {self.class_prefix!r}: {many}")

    def _ask(self, prompt: str, seed: int, **more) -> dict:
        return self.request({"messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "top_p": self.top_p, "seed": seed, **more})

    def generate(self, prompts, seeds):
        out = []
        for p, s in zip(prompts, seeds, strict=True):
            choices = self._ask(p, s, max_completion_tokens=self.max_tokens).get("choices") or [{}]
            out.append((choices[0].get("message") or {}).get("content") or "")
        return out

    def scores_of(self, response: dict, classes: list[str]) -> np.ndarray:
        """Softmax over the classes' log-probabilities; all NaN if a class is not among the candidates."""
        try:
            top = response["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
        except (KeyError, IndexError, TypeError):
            top = []
        table: dict[str, float] = {}
        for t in top:
            table.setdefault(t["token"], t["logprob"])
        x = np.array([table.get(self.class_prefix + c, np.nan) for c in classes], float)
        if np.isnan(x).any():
            return np.full(len(classes), np.nan)
        e = np.exp(x - x.max())
        return e / e.sum()

    def score_classes(self, prompts, classes, seeds):
        return np.array([self.scores_of(self._ask(p, s, max_completion_tokens=1, logprobs=True, top_logprobs=MAX_CLASSES), classes) for p, s in zip(prompts, seeds, strict=True)]).reshape(len(prompts), len(classes))

    def close(self) -> None:
        self.closed = True
