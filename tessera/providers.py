"""The boundary to outside services: embedders, generators and tokenizers are injected, never imported here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, question: str, context: str) -> str: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class Rejected(Exception):
    """A provider does not take the output schema (its answers 400 and 422); no other failure is one."""


# The names and types of the output contract.
OUTPUT_SCHEMA = {
    "type": "json_schema",
    "json_schema": {
        "name": "grounded_answer",
        "strict": True,
        "schema": {
            "type": "object",
            "additionalProperties": False,
            "properties": {
                "answer": {"type": "string"},
                "claims": {
                    "type": "array",
                    "items": {
                        "type": "object",
                        "additionalProperties": False,
                        "properties": {"statement": {"type": "string"}, "passages": {"type": "array", "items": {"type": "integer"}}, "verbatim": {"type": "string"}},
                        "required": ["statement", "passages", "verbatim"],
                    },
                },
            },
            "required": ["answer", "claims"],
        },
    },
}
PREFIX = (
    "Rispondi solo con ciò che i passaggi dicono. Cita i passaggi per numero, come [n]. Per ogni affermazione riporta in "
    "verbatim le parole esatte del passaggio. Rispondi in JSON: answer, claims (statement, passages, verbatim)."
)


class SchemaGenerator:
    """Asks a provider for an answer by the output contract, and again for plain JSON if it does not take the schema.

    call(messages, response_format, cache_key) gives the text, or the text and its usage. The prefix is the same for every
    question, so that providers can cache it.
    """

    def __init__(self, call: Callable, cache_key: str = "", prefix: str = PREFIX):
        self.call, self.cache_key, self.prefix = call, cache_key, prefix

    def generate(self, question: str, context: str):
        messages = [{"role": "system", "content": self.prefix}, {"role": "user", "content": f"Passaggi:\n\n{context}\n\n---\n\nDomanda: {question}"}]
        try:
            return self.call(messages, OUTPUT_SCHEMA, self.cache_key)
        except Rejected:
            return self.call(messages, {"type": "json_object"}, self.cache_key)


def client(key: str | None, make: Callable, timeout_s: float = 60.0, retries: int = 4):
    """make(key, timeout_s, retries), or None without a key."""
    return make(key, timeout_s, retries) if key and key.strip() else None


USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cached_tokens:bigint>"


def usage_of(given: dict | None) -> dict | None:
    """Usage by its four names; cached tokens default to 0, no usage stays null."""
    if not given:
        return None
    return {k: int(given.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens")}


class Unavailable(Exception):
    """A provider did not answer in time or limited the rate."""


def with_retries(call: Callable, retries: int = 4, pause_s: float = 20.0, sleep: Callable = time.sleep):
    """call(), again after pauses that double; the last failure is raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Unavailable:
            if attempt == retries:
                raise
            sleep(pause_s * 2**attempt)


def embedded(rows: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """rows (id, content) with their vector; blank texts get zeros. One batch of vectors is alive at a time."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                asked = [t for t in texts if t.strip()]
                got = iter(embedder.embed(asked)) if asked else iter(())
                vectors = [next(got) if t.strip() else [0.0] * embedder.dim for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float64()))], ["id", "content", "vector"])

    return rows.select("id", "content").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, content string, vector array<double>")


class Words:
    """A tokenizer that needs no vocabulary: words with the white space after them."""

    def encode(self, text: str) -> list[str]:
        import re

        return re.findall(r"\S+\s*|\s+", text)

    def decode(self, ids: list[str]) -> str:
        return "".join(ids)


class FirstSentence:
    """A generator that needs no model: it quotes the first passage's first sentence as its only claim."""

    def generate(self, question: str, context: str) -> str:
        import json

        body = context.split("\n", 1)[1] if "\n" in context else ""
        sentence = body.split("\n\n---\n\n")[0].split(". ")[0].strip()
        claims = [{"statement": sentence, "passages": [1], "verbatim": sentence}] if sentence else []
        return json.dumps({"answer": f"{sentence} [1]" if sentence else "", "claims": claims}, ensure_ascii=False)


def generated(rows: DataFrame, generator: Generator, retries: int = 4, pause_s: float = 20.0) -> DataFrame:
    """rows (query_id, question, context) with raw output, error and usage; a provider that stays away costs its row only.

    A generator gives its text, or the text and a dictionary of its usage.
    """

    def run(batches):
        for b in batches:
            raw, error, used = [], [], []
            for q, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    got = with_retries(lambda q=q, c=c: generator.generate(q, c), retries, pause_s)
                    got = got if isinstance(got, tuple) else (got, None)
                    raw.append(got[0])
                    error.append(None)
                    used.append(usage_of(got[1]))
                except Unavailable as e:
                    raw.append(None)
                    error.append(str(e) or "unavailable")
                    used.append(None)
            kind = pa.struct([(k, pa.int64()) for k in ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.string()), pa.array(error, pa.string()), pa.array(used, kind)], ["query_id", "raw", "error", "usage"])

    return rows.select("query_id", "question", "context").mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, raw string, error string, usage {USAGE}")
