"""Embedding of texts: each distinct wording once, in planned batches.

An embedder turns a list of texts into vectors; the operator finds the distinct
texts, runs the embedder on the executors and joins the vectors back on the exact
text.
"""

from __future__ import annotations

import json
import math
import random
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import RequestError
from ..functions.text import MOCK_DIM, fnv1a_many

BATCH_ITEMS, BATCH_CHARS = 64, 48_000


def plan_batches(lengths: list[int], items: int = BATCH_ITEMS, chars: int = BATCH_CHARS) -> list[list[int]]:
    """Consecutive groups of at most ``items`` texts and ``chars`` characters; a
    longer text goes alone."""
    groups: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if not groups or len(groups[-1]) >= items or n > room:
            groups.append([])
            room = chars
        groups[-1].append(i)
        room -= n
    return groups


def validate(vectors: list, name: str = "") -> int | None:
    """The common dimension; raises where vectors can't be searched."""
    dim = None
    for i, v in enumerate(vectors):
        if isinstance(v, str) or not hasattr(v, "__len__"):
            raise RequestError(502, f"{name}: item {i} is no vector")
        dim = len(v) if dim is None else dim
        if len(v) != dim:
            raise RequestError(502, f"{name}: item {i} has {len(v)} dimensions instead of {dim}")
        if not all(isinstance(x, (int, float, np.floating)) and math.isfinite(x) for x in v):
            raise RequestError(502, f"{name}: item {i} holds a number that isn't finite")
    return dim


class Embedder:
    """Base: subclasses give ``batch``; ``name`` says which."""

    name = "base"
    items, chars = BATCH_ITEMS, BATCH_CHARS

    def batch(self, texts: list[str]) -> list:
        raise NotImplementedError

    def __call__(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        for group in plan_batches([len(t) for t in texts], self.items, self.chars):
            for i, v in zip(group, self._group([texts[i] for i in group])):
                out[i] = v
        validate(out, self.name)
        return out

    def _group(self, texts: list[str]) -> list:
        """A batch; if it fails for a reason other than a rate limit, its texts
        one by one, so a single bad text doesn't sink the others."""
        try:
            return self.batch(texts)
        except RequestError as e:
            if e.status == 429 or len(texts) == 1:
                raise
            return [self.batch([t])[0] for t in texts]


class MockEmbedder(Embedder):
    """Offline: token counts by hash bucket, scaled to length 1."""

    name = "mock"

    def batch(self, texts):
        tokens = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
        flat = fnv1a_many([t for own in tokens for t in own]) % MOCK_DIM
        row = np.repeat(np.arange(len(texts)), [len(own) for own in tokens])
        counts = np.bincount(row * MOCK_DIM + flat, minlength=len(texts) * MOCK_DIM).reshape(len(texts), MOCK_DIM).astype(float)
        norm = np.sqrt((counts**2).sum(1, keepdims=True))
        return list(counts / np.where(norm == 0, 1, norm))


@dataclass
class HttpEmbedder(Embedder):
    """An OpenAI-compatible embeddings endpoint."""

    url: str
    model: str
    key: str = ""
    timeout_s: float = 60.0
    retries: int = 5
    first_wait_s: float = 0.5
    budget_s: float = 45.0
    items: int = BATCH_ITEMS
    chars: int = BATCH_CHARS
    name: str = "http"

    def __post_init__(self):
        if not self.url or not self.model:
            raise RequestError(400, "an embedding url and model are required")

    def batch(self, texts):
        body = json.dumps({"model": self.model, "input": texts}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        waited, tries, refused = 0.0, 0, 0
        while True:
            wait = None
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url.rstrip("/") + "/embeddings", body, head), timeout=self.timeout_s) as r:
                    data = json.load(r).get("data") or []
                if len(data) != len(texts):
                    raise RequestError(502, f"{len(data)} vectors for {len(texts)} texts")
                return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index") or 0)]
            except urllib.error.HTTPError as e:
                if e.code == 429:
                    refused += 1
                    wait = retry_after(e.headers) or refusal_wait(refused, self.first_wait_s)
                    if waited + wait > self.budget_s:
                        who = limiter(e.headers, e.read().decode("utf-8", "replace"))
                        raise RequestError(429, f"the embedding provider keeps refusing ({who} limit) after {readable(waited * 1000)}") from e
                elif e.code < 500:
                    raise RequestError(502, f"the embedding provider answered {e.code}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                if tries >= self.retries:
                    raise RequestError(502, f"the embedding provider failed: {e}") from e
            if wait is None:
                tries += 1
                if tries > self.retries:
                    raise RequestError(502, "the embedding provider failed")
                wait = min(60.0, 2.0**tries) + random.random()
            waited += wait
            time.sleep(wait)


def refusal_wait(refused: int, first_s: float = 0.5) -> float:
    """Seconds before the next try after so many refusals in a row."""
    return min(120.0, first_s * 2 ** (refused - 1)) * (1 + 0.1 * random.random())


LONGEST_WAIT_S = 600.0


def reset_wait(value, now_s: float) -> float | None:
    """Seconds until a limit resets.  The header doesn't say its unit; its size does:
    a short wait, a point in time in seconds, or one in milliseconds."""
    try:
        size = float(value)
    except (TypeError, ValueError):
        return None
    if size > LONGEST_WAIT_S:
        size = (size / 1000 if size > 100 * now_s else size) - now_s
    return size if 0 < size <= LONGEST_WAIT_S else None


def retry_after(headers, now_s: float | None = None) -> float | None:
    """Seconds that a refusal's headers ask for, if any."""
    try:
        return min(LONGEST_WAIT_S, max(0.0, float(headers.get("Retry-After"))))
    except (TypeError, ValueError):
        return reset_wait(headers.get("X-RateLimit-Reset"), time.time() if now_s is None else now_s)


def _said(value, quoted: bool = False):
    """(name, text, quoted) of every text in a decoded answer; texts may quote
    another answer, as JSON from their first brace on."""
    if isinstance(value, list):
        value = {str(i): x for i, x in enumerate(value)}
    if not isinstance(value, dict):
        return
    for name, inner in value.items():
        if not isinstance(inner, str):
            yield from _said(inner, quoted)
            continue
        yield name, inner, quoted
        if "{" in inner:
            try:
                answer, _ = json.JSONDecoder().raw_decode(inner, inner.index("{"))
            except ValueError:
                continue
            yield from _said(answer, True)


def _status_line(text: str) -> bool:
    head, colon, _ = text.lstrip().partition(":")
    return bool(colon) and head.startswith("HTTP ") and head[5:].isdigit() and len(head) == 8


def limiter(headers, body: str = "") -> str:
    """Who refused: "account" (limit headers, or an answer of that type), "upstream"
    (another provider's answer, relayed as a status line or quoted) or "unknown".
    Headers decide first, then what is relayed."""
    if any(headers.get(f"X-RateLimit-{k}") for k in ("Limit", "Remaining", "Reset")):
        return "account"
    try:
        answer = json.loads(body)
    except ValueError:
        answer = {"": body}
    said = list(_said(answer))
    if any(_status_line(text) or (quoted and name == "type" and "rate" in text) for name, text, quoted in said):
        return "upstream"
    return "account" if ("error_type", "rate_limit_exceeded") in {s[:2] for s in said} else "unknown"


def readable(ms: float) -> str:
    """A duration for people: whole milliseconds below a second, then seconds, with
    a tenth below ten unless it is zero."""
    whole = max(0, round(ms))
    if whole < 1000:
        return f"{whole}ms"
    seconds = whole / 1000
    return f"{seconds:.{int(seconds < 10)}f}".removesuffix(".0") + "s"


@dataclass
class OnnxEmbedder(Embedder):
    """A local ONNX model and its tokenizer file: mean pooling, scaled to length 1."""

    model_path: str
    tokenizer_path: str
    name: str = "onnx"

    def batch(self, texts):
        try:
            import onnxruntime
            from tokenizers import Tokenizer
        except ImportError as e:
            raise RequestError(501, "local embedding needs onnxruntime and tokenizers") from e
        if not hasattr(self, "_session"):
            self._session = onnxruntime.InferenceSession(self.model_path)
            self._tokenizer = Tokenizer.from_file(self.tokenizer_path)
            self._tokenizer.enable_padding()
        encoded = self._tokenizer.encode_batch(texts)
        ids = np.array([e.ids for e in encoded], np.int64)
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        names = {i.name for i in self._session.get_inputs()}
        hidden = self._session.run(None, {k: v for k, v in feed.items() if k in names})[0]
        pooled = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return list(pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12))


def embedder(provider: str = "mock", **options) -> Embedder:
    """The embedder of a provider: mock, openrouter, custom (HTTP) or transformers."""
    kinds = {"mock": MockEmbedder, "openrouter": HttpEmbedder, "custom": HttpEmbedder, "transformers": OnnxEmbedder}
    if provider not in kinds:
        raise RequestError(400, f'Unknown embedding provider "{provider}"')
    if provider == "openrouter":
        options.setdefault("url", "https://openrouter.ai/api/v1")
    return kinds[provider](**options)


def embed(rows: DataFrame, model: Embedder, text_col: str = "text", out_col: str = "vector", parallel: int | None = None) -> DataFrame:
    """Adds the vector (floats) of each row's text; distinct texts are embedded
    once.  ``parallel`` limits the tasks that call the model at a time."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(v, np.float32) for v in model(texts)], pa.list_(pa.float32()))], names=["__text", "__vector"])

    distinct = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text")).distinct()
    distinct = distinct.coalesce(parallel) if parallel else distinct
    vectors = distinct.mapInArrow(run, "__text string, __vector array<float>")
    joined = rows.join(vectors, F.coalesce(F.col(text_col), F.lit("")) == F.col("__text"))
    return joined.drop("__text").withColumnRenamed("__vector", out_col)
