"""Model calls behind small protocols, each with a deterministic offline default.

A model is any object with the method of its protocol; it is pickled to the workers and called on Arrow batches.
Retries are bounded: `retrying` waits with growing pauses and then lets the error through.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, question: str, texts: Sequence[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> list[str]: ...


class Cooldown:
    """A pause that all calls of one worker keep after a refused one, so that they don't knock one after the other."""

    def __init__(self, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.seconds, self.clock, self.sleep, self.until = seconds, clock, sleep, 0.0

    def wait(self) -> None:
        left = self.until - self.clock()
        if left > 0:
            self.sleep(left)

    def start(self) -> None:
        self.until = max(self.until, self.clock() + self.seconds)


class Refused(Exception):
    """Raised by a model that is asked too often; starts the shared pause."""


#: The pause of this Python worker.
COOLDOWN = Cooldown()


def retrying(call: Callable, attempts: int = 3, pause: float = 1.0, most: float = 10.0, cooldown: Cooldown | None = None):
    """The result of `call`, tried at most `attempts` times; a `Refused` call makes all calls of the worker wait."""
    shared = cooldown or COOLDOWN
    for attempt in range(attempts):
        shared.wait()
        try:
            return call()
        except Refused:
            if attempt + 1 == attempts:
                raise
            shared.start()
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(min(pause * 2**attempt, most))


def complete(reply: str | None) -> bool:
    """Whether a reply was not cut off: it isn't blank, and braces, brackets and tags it opens are closed."""
    text = (reply or "").strip()
    return bool(text) and text.count("{") == text.count("}") and text.count("[") == text.count("]") and ("<answer>" not in text or "</answer>" in text)


def asked(prompts, model: Generator, valid: Callable[[str], bool] = complete, repair: str = "The previous reply was invalid. Reply with one complete JSON object.", attempts: int = 3):
    """A string column of replies to a column of prompts.

    A reply that isn't `valid` is asked for again with the repair request, the prompt and the last reply, at most
    `attempts` times in all; after that it is null. All prompts of an Arrow batch go to the model together.
    """

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(batch)
        open_ = [(i, p) for i, p in enumerate(batch) if p is not None]
        for _ in range(attempts):
            if not open_:
                break
            replies = retrying(lambda now=open_: model.generate([p for _, p in now]))
            if len(replies) != len(open_):
                raise ValueError("a generator must give one reply per prompt")
            left = []
            for (i, p), reply in zip(open_, replies):
                if valid(reply):
                    out[i] = reply
                else:
                    left.append((i, f"{repair}\nPREVIOUS: {reply}\n{batch.iloc[i]}"))
            open_ = left
        return pd.Series(out, dtype=object)

    return run(F.col(prompts) if isinstance(prompts, str) else prompts)


class HashEmbedder:
    """Bag of words hashed into a fixed number of signed dimensions, at length 1; blank text is the zero vector."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for t in _TOKEN.findall((text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


class OverlapReranker:
    """Share of the question's tokens that a text holds."""

    def score(self, question: str, texts: Sequence[str]) -> list[float]:
        asked = set(_TOKEN.findall((question or "").lower()))
        return [len(asked & set(_TOKEN.findall((t or "").lower()))) / len(asked) if asked else 0.0 for t in texts]


class TemplateGenerator:
    """Answers with the first sentences of the evidence in the prompt."""

    def __init__(self, sentences: int = 2) -> None:
        self.sentences = sentences

    def generate(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            evidence = (p or "").rsplit("EVIDENCE:", 1)[-1].strip()
            out.append(" ".join(re.split(r"(?<=[.!?])\s+", evidence)[: self.sentences]))
        return out


def embed_column(df, text: str, into: str, embedder: Embedder | None = None, prefix: str = ""):
    """Adds the embedding of a text column; a row keeps its vector by construction, blanks included.

    `prefix` is put before each text, for models that tell passages from queries by it.
    """
    model = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(retrying(lambda: model.embed([prefix + (t or "") for t in texts])))

    return df.withColumn(into, run(F.col(text)))


class BytePairCounter:
    """Counts the tokens of words by a published byte-pair vocabulary in a file; a word is counted with the blank before it.

    The file is read once in each worker; without it the error comes at the first count.
    """

    # Fixed value: the published split pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        self.path, self._encoding = path, None

    def __getstate__(self):
        return {"path": self.path, "_encoding": None}

    def __call__(self, words: list[str]) -> list[int]:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self._encoding = tiktoken.Encoding("byte_pairs", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return [len(self._encoding.encode_ordinary(" " + w)) for w in words]
