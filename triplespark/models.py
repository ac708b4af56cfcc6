"""The models behind the engine as small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class EntityModel(Protocol):
    def predict(self, text: str) -> list[tuple[int, int, str]]: ...


class ScriptedModel:
    """Answers by the first pattern that occurs in the last message, else by a default."""

    def __init__(self, script: list[tuple[str, str]], default: str = ""):
        self.script, self.default = script, default

    def chat(self, messages: list[dict[str, str]]) -> str:
        return next((answer for pattern, answer in self.script if re.search(pattern, messages[-1]["content"])), self.default)


class HalvingModel:
    """Asks a model again with each half of the last message if it fails, to a bounded depth, and joins the replies."""

    def __init__(self, model: LanguageModel, depth: int = 4):
        self.model, self.depth = model, depth

    def chat(self, messages: list[dict[str, str]], depth: int | None = None) -> str:
        left = self.depth if depth is None else depth
        try:
            return self.model.chat(messages)
        except Exception:
            text = messages[-1]["content"]
            if left == 0 or len(text) < 2:
                raise
            halves = (text[: len(text) // 2], text[len(text) // 2 :])
            return "".join(self.chat([*messages[:-1], {**messages[-1], "content": h}], left - 1) for h in halves)


class HashingEmbedder:
    """Unit vectors of hashed letter trigrams."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
        return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


class LetterEmbedder:
    """How often each letter and digit occurs, in either case: vectors that SQL can compute too."""

    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[low.count(c) for c in self.alphabet] for low in map(str.lower, texts)], np.float32).reshape(len(texts), len(self.alphabet))


class PatternEntities:
    """Finds what a pattern matches, all of one type."""

    def __init__(self, pattern: str, label: str):
        self.pattern, self.label = pattern, label

    def predict(self, text: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), self.label) for m in re.finditer(self.pattern, text)]


class Gazetteer:
    """Finds listed names, longest first, as whole words."""

    def __init__(self, names: dict[str, str]):
        self.labels = {k.lower(): v for k, v in names.items()}
        ordered = sorted(self.labels, key=lambda k: (-len(k), k))
        self.pattern = r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + r")(?!\w)" if ordered else r"(?!)"

    def predict(self, text: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), self.labels[m[0].lower()]) for m in re.finditer(self.pattern, text)]


def embed(texts: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """(text, emb) of the distinct texts, in batches on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.embed(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["text"], pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], ["text", "emb"])

    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    return distinct.mapInArrow(run, "text string, emb array<float>")


def ask(prompts: DataFrame, model: LanguageModel, column: str = "prompt", system: str | None = None) -> DataFrame:
    """prompts with ``response``, asked on the executors a batch at a time."""
    lead = [{"role": "system", "content": system}] if system else []

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else model.chat([*lead, {"role": "user", "content": t}]) for t in texts.to_pylist()], pa.string())

    return prompts.withColumn("response", F.arrow_udf(run, "string")(F.col(column)))
